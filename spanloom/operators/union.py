"""Many records into one: words of overlapping windows with an alias map, segments rewired to them, and groups of events as one event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .cues import _let

ORDER = ("t0", "t1", "id")


def _same(a: Column, b: Column, share: float, tolerance: float) -> Column:
    """Words of one text that overlap by ``share`` of the shorter one, less ``tolerance``, and whose languages do not differ."""
    overlap = F.least(a["t1"], b["t1"]) - F.greatest(a["t0"], b["t0"])
    shortest = F.least(a["t1"] - a["t0"], b["t1"] - b["t0"])
    spoken = [F.coalesce(F.lower(x["language"]), F.lit("")) for x in (a, b)]
    return (overlap >= -tolerance) & (overlap >= shortest * share - tolerance) & ((spoken[0] == "") | (spoken[1] == "") | (spoken[0] == spoken[1]))


def union_words(words: DataFrame, by: Sequence[str], share: float = 0.5, tolerance: float = 0.08) -> tuple[DataFrame, DataFrame]:
    """The words (id, t0, t1, text, confidence, language) that stay of all windows, and the aliases (by, id, canonical) of the others.

    In order of time, a word that repeats one kept so far goes, or takes its place if it is surer, then longer, then of a shorter id;
    of several that it repeats the one kept longest counts. An alias always names a word that stays. Only words of one text can repeat
    each other, and only where they touch, so each fold sees one text's touching words, whole: those that stay need no join to be found again.
    """
    norm = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    w = W.partitionBy(*by, "_norm").orderBy(*ORDER)
    reach = F.max("t1").over(w.rowsBetween(W.unboundedPreceding, -1))
    seen = words.withColumn("_norm", norm).withColumn("_new", F.coalesce((F.col("t0") - reach > tolerance).cast("int"), F.lit(0))).withColumn("_island", F.sum("_new").over(w))
    rest = [c for c in words.columns if c not in (*by, *ORDER, "language")]
    item = F.struct(*ORDER, F.coalesce("confidence", F.lit(0.0)).cast("double").alias("_sure"), "language", F.struct(*rest).alias("_rest"))
    islands = seen.groupBy(*by, "_norm", "_island").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = islands.schema["items"].dataType.elementType
    alias = lambda a, b: F.struct(a.cast("string").alias("id"), b.cast("string").alias("canonical"))
    state = lambda kept, gone: F.struct(kept.alias("kept"), gone.alias("gone"))
    rank = lambda x: F.struct(x["_sure"], x["t1"] - x["t0"], -F.length(x["id"].cast("string")))

    def step(acc: Column, x: Column) -> Column:
        return _let(F.get(F.filter(acc["kept"], lambda k: _same(k, x, share, tolerance)), F.lit(0)), lambda old: decided(acc, x, old))

    def decided(acc: Column, x: Column, old: Column) -> Column:
        wins = rank(x) > rank(old)
        rest = F.filter(acc["kept"], lambda k: k["id"] != old["id"])
        # what stood for the word that goes now stands for the one that comes
        moved = F.transform(acc["gone"], lambda g: alias(g["id"], F.when(g["canonical"] == old["id"].cast("string"), x["id"].cast("string")).otherwise(g["canonical"])))
        return (
            F.when(old.isNull(), state(F.concat(acc["kept"], F.array(x)), acc["gone"]))
            .when(wins, state(F.concat(rest, F.array(x)), F.concat(moved, F.array(alias(old["id"], x["id"])))))
            .otherwise(state(acc["kept"], F.concat(acc["gone"], F.array(alias(x["id"], old["id"])))))
        )

    none = state(F.array().cast(f"array<{kind.simpleString()}>"), F.array().cast("array<struct<id:string,canonical:string>>"))
    # a word alone needs no fold
    alone = F.size("items") == 1
    folded = islands.withColumn("_s", F.when(alone, state(F.col("items"), none["gone"])).otherwise(F.aggregate("items", none, step)))
    kept = folded.select(*by, F.explode("_s.kept").alias("_w")).select(*by, *[F.col(f"_w.{c}") for c in (*ORDER, "language")], *[F.col(f"_w._rest.{c}") for c in rest]).select(*words.columns)
    gone = folded.select(*by, F.inline("_s.gone"))
    id_type = words.schema["id"].dataType
    return kept, gone.select(*by, F.col("id").cast(id_type).alias("id"), F.col("canonical").cast(id_type).alias("canonical"))


def rewire_segments(segments: DataFrame, words: DataFrame, aliases: DataFrame, by: Sequence[str]) -> DataFrame:
    """``segments`` (n, id, words) on the words that stay, in their order; of segments with the same words the first by ``n`` stays.

    Segments without words go. A repeated segment id gets a number. Adds ``t0``, ``t1`` of the words.
    """
    named = segments.select(*by, "n", F.col("id").alias("segment"), F.explode("words").alias("id")).join(aliases, [*by, "id"], "left")
    named = named.select(*by, "n", "segment", F.coalesce("canonical", "id").alias("id")).join(words.select(*by, *ORDER), [*by, "id"])
    lists = named.groupBy(*by, "n", "segment").agg(F.sort_array(F.collect_set(F.struct(*ORDER))).alias("_w"))
    ids = F.transform("_w", lambda x: x["id"])
    once = lists.withColumn("words", ids).withColumn("_k", F.row_number().over(W.partitionBy(*by, "words").orderBy("n"))).where("_k = 1")
    again = F.row_number().over(W.partitionBy(*by, "segment").orderBy("n"))
    out = once.withColumn("_a", again).withColumn("id", F.when(F.col("_a") == 1, F.col("segment").cast("string")).otherwise(F.concat_ws(":dup", F.col("segment").cast("string"), F.col("_a").cast("string"))))
    return out.select(*by, "n", "id", "words", F.col("_w")[0]["t0"].alias("t0"), F.array_max(F.transform("_w", lambda x: x["t1"])).alias("t1"))


def merge_groups(events: DataFrame, by: Sequence[str], reason: str = "merge") -> DataFrame:
    """One event of each group ``by`` of events (id, t0, t1, text, speaker, status, p0, p1, word_ids, spans), with where it comes from.

    Word ids are listed once, spans one after another; times go from the first event's start to the last one's end, physical times over all.
    The speaker is the first confirmed one, else the most frequent (the smaller of equally frequent). ``trace`` names the events and their texts.
    """
    item = F.struct("t0", "id", "t1", "text", "speaker", "status", "word_ids", "spans")
    grouped = events.groupBy(*by).agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.min("p0").alias("p0"), F.max("p1").alias("p1"),
    )
    counted = events.where("speaker is not null").groupBy(*by, "speaker").agg(F.count(F.lit(1)).alias("n"))
    most = counted.groupBy(*by).agg(F.max_by("speaker", F.struct("n", -F.col("speaker"))).alias("_most"))
    items, i0, i1 = F.col("items"), F.col("items")[0], F.element_at("items", -1)
    sure = F.get(F.filter(items, lambda i: i["speaker"].isNotNull() & (i["status"] == "confirmed")), F.lit(0))
    status = F.when(sure.isNotNull(), "confirmed").when(F.col("_most").isNotNull(), F.coalesce(i0["status"], F.lit("unknown"))).otherwise("unknown")
    texts = F.transform(items, lambda i: i["text"])
    trace = F.struct(F.lit("merge").alias("op"), F.lit(reason).alias("reason"), F.transform(items, lambda i: i["id"]).alias("ids"), texts.alias("texts"))
    return grouped.join(most, list(by), "left").select(
        *by, i0["id"].alias("id"), i0["t0"].alias("t0"), i1["t1"].alias("t1"), F.array_join(texts, " ").alias("text"), F.coalesce(sure["speaker"], "_most").alias("speaker"), status.alias("status"), "p0", "p1",
        F.array_distinct(F.flatten(F.transform(items, lambda i: i["word_ids"]))).alias("word_ids"), F.flatten(F.transform(items, lambda i: i["spans"])).alias("spans"), trace.alias("trace"),
    )
