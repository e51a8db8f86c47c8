"""Speakers of two sources: ids mapped by what they share in time, fused per event, and changes between neighbouring voices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import letters
from ..functions.vector import dot
from . import intervals as iv
from .assembly import turn_at


def map_speakers(turns: DataFrame, events: DataFrame, by: Sequence[str], width: float) -> DataFrame:
    """(by, speaker, label): the ids of ``turns`` (id, speaker, t0, t1) one to one onto the labels of ``events`` (id, label, t0, t1) by shared seconds.

    The pair that shares most is taken first (of equal ones the larger speaker, then the larger label). A key where some speaker finds no label
    has no mapping at all, as a part of one would merge people. The greedy step sees one row for each pair of ids.
    """
    met = iv.overlap_join(events.where("label is not null").select(*by, "label", "t0", "t1"), turns.select(*by, "speaker", "t0", "t1"), by, width)
    shared = met.groupBy(*by, F.col("r_speaker").alias("speaker"), "label").agg(F.sum(iv.overlap_seconds()).alias("s")).where("s > 0")
    pairs = shared.groupBy(*by).agg(F.reverse(F.array_sort(F.collect_list(F.struct("s", "speaker", "label")))).alias("_pairs"))
    known = turns.groupBy(*by).agg(F.count_distinct("speaker").alias("_n"))
    none = F.slice("_pairs", F.lit(1), F.lit(0))

    def take(out: Column, p: Column) -> Column:
        taken = F.exists(out, lambda o: (o["speaker"] == p["speaker"]) | (o["label"] == p["label"]))
        return F.when(taken, out).otherwise(F.concat(out, F.array(p)))

    held = pairs.withColumn("_taken", F.aggregate("_pairs", none, take)).join(known, list(by)).where(F.size("_taken") == F.col("_n"))
    return held.select(*by, F.inline(F.transform("_taken", lambda p: F.struct(p["speaker"], p["label"]))))


def fuse_speakers(events: DataFrame, turns: DataFrame, by: Sequence[str], width: float) -> DataFrame:
    """``events`` (id, label, t0, t1) with a speaker from the turn at their middle and their own label.

    Where the turn's speaker is mapped to another label than the event's, both are dropped. Speakers are numbered from 0 by id. Adds
    ``speaker``, ``name`` (a letter), ``source`` (fused, global, embedding, unknown) and ``repair`` (why a speaker is unknown, else empty).
    """
    heard = turn_at(events.select(*by, "id", ((F.col("t0") + F.col("t1")) / 2).alias("t")), turns, by, width).withColumnRenamed("speaker", "_global")
    named = map_speakers(turns, events, by, width).select(*by, F.col("speaker").alias("_global"), F.col("label").alias("_mapped"))
    held = events.join(heard, [*by, "id"], "left").join(named, [*by, "_global"], "left")
    g, label, mapped = F.col("_global"), F.col("label"), F.col("_mapped")
    both = g.isNotNull() & label.isNotNull()
    conflict = both & (mapped != label)
    source = F.when(conflict, "unknown").when(both & mapped.isNotNull(), "fused").when(g.isNotNull(), "global").when(label.isNotNull(), "embedding").otherwise("unknown")
    held = held.withColumn("source", source).withColumn("_s", F.when(F.col("source") == "fused", mapped).when(F.col("source") == "global", g).when(F.col("source") == "embedding", label))
    place = F.dense_rank().over(W.partitionBy(*by).orderBy(F.col("_s").asc_nulls_last())) - 1
    repair = F.when(F.coalesce(conflict, F.lit(False)), "speaker_evidence_conflict").when(F.col("source") == "unknown", "speaker_evidence_unavailable").otherwise("")
    out = held.withColumn("speaker", F.when(F.col("_s").isNotNull(), place)).withColumn("name", F.concat(F.lit("Speaker "), letters(F.col("speaker"))))
    return out.select(*events.columns, "speaker", "name", "source", repair.alias("repair"))


def voice_changes(words: DataFrame, by: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """(by, at, score): the times between neighbouring words (id, t0, t1, v) whose voices differ.

    The score is four fifths of half the cosine distance and one fifth of the pause, of which a quarter of a second counts in full. Words without a
    vector part nothing; a vector of zeros is at no distance from any.
    """
    w = W.partitionBy(*by).orderBy("t0", "t1", "id")
    pairs = words.withColumn("_v", F.lag("v").over(w)).withColumn("_z", F.lag("t1").over(w)).where("_v is not null and v is not null")
    size = F.sqrt(dot(F.col("_v"), F.col("_v"))) * F.sqrt(dot(F.col("v"), F.col("v")))
    away = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(F.col("_v"), F.col("v")) / size)))
    pause = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("t0") - F.col("_z")) / 0.25)
    at = F.when(F.col("t0") > F.col("_z"), F.col("_z")).otherwise(F.col("t0"))
    return pairs.select(*by, at.alias("at"), (0.8 * away / 2 + 0.2 * pause).alias("score")).where(F.col("score") >= threshold)
