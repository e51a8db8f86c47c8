"""Ordered groups onto legal start and end candidates, as a machine of states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: States and what may follow each.
STATES = {
    "proposed": ("projected",), "projected": ("accepted", "merged", "one_repair", "fallback"), "merged": ("accepted", "fallback", "one_repair"), "one_repair": ("projected", "fallback"), "accepted": (), "fallback": (),
}


def _nearest(targets: DataFrame, candidates: DataFrame, by: Sequence[str], most: float, name: str) -> DataFrame:
    """(by, n, name: struct<at, id, confidence>): the candidate nearest to each target within ``most``; of equally near ones the earlier, then the smaller id."""
    b = lambda c: F.floor(F.col(c) / most).cast("long")
    near = targets.withColumn("_b", F.explode(F.array(*[b("t") + k for k in (-1, 0, 1)])))
    met = near.join(candidates.select(*by, F.col("id").alias("_id"), "at", "confidence").withColumn("_b", b("at")), [*by, "_b"]).where(F.abs(F.col("at") - F.col("t")) <= most)
    best = F.struct("at", F.col("_id").alias("id"), "confidence")
    return met.groupBy(*by, "n").agg(F.min_by(best, F.struct(F.abs(F.col("at") - F.col("t")), "at", "_id")).alias(name))


def project_boundaries(groups: DataFrame, starts: DataFrame, ends: DataFrame, by: Sequence[str], longest: float = 5.0, most: float = 0.5) -> DataFrame:
    """``groups`` (n, t0, t1, p0, p1, speaker, region, split_before, split_after) with projected times and the states they went through.

    A group's physical times (its own where it has none) go to the nearest candidate (id, at, confidence) within ``most``. It is accepted if both
    exist, in order and no more than ``longest`` apart; else merged with what it has if the next group may join it (speakers and regions that do
    not differ, no hard split between them); else it falls back to its own times. Adds start, end, start_id, end_id, confidence (of both), state,
    states and warnings (inverted, too_long, no_start, no_end).
    """
    aim = groups.withColumn("_a", F.coalesce("p0", "t0")).withColumn("_z", F.coalesce("p1", "t1"))
    a, z = (_nearest(aim.select(*by, "n", F.col(c).alias("t")), k, by, most, name) for c, k, name in (("_a", starts, "_s"), ("_z", ends, "_e")))
    met = aim.join(a, [*by, "n"], "left").join(z, [*by, "n"], "left")
    w = W.partitionBy(*by).orderBy("n")
    nxt = {c: F.lead(c).over(w) for c in ("n", "speaker", "region", "split_before")}
    agree = lambda c: F.coalesce(F.col(c) == nxt[c], F.lit(True))
    joins = nxt["n"].isNotNull() & agree("speaker") & agree("region") & ~(F.coalesce("split_after", F.lit(False)) | F.coalesce(nxt["split_before"], F.lit(False)))
    long = F.col("_e.at") - F.col("_s.at")
    faults = F.array(*[F.when(c, F.lit(n)) for n, c in (("inverted", long <= 0), ("too_long", (long > 0) & (long > longest)), ("no_start", F.col("_s").isNull()), ("no_end", F.col("_e").isNull()))])
    met = met.withColumn("warnings", F.filter(faults, lambda x: x.isNotNull())).withColumn("state", F.when(F.size("warnings") == 0, "accepted").when(joins, "merged").otherwise("fallback"))
    falls = F.col("state") == "fallback"
    side = lambda c, own, name: [
        F.when(falls, F.col(own)).otherwise(F.coalesce(f"{c}.at", own)).alias(name), F.when(falls, "fallback").otherwise(F.coalesce(f"{c}.id", F.lit("merge-fallback"))).alias(f"{name}_id"),
        F.when(falls, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(f"{c}.confidence", F.lit(0.0))))).alias(f"{name}_confidence"),
    ]
    states = F.array(F.lit("proposed"), F.lit("projected"), F.col("state"))
    return met.select(*groups.columns, *side("_s", "_a", "start"), *side("_e", "_z", "end"), "state", states.alias("states"), "warnings")


def repair_projections(projected: DataFrame, repairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups of ``project_boundaries`` that were merged get their repair (n, start, end), once; those without one fall back, with a warning."""
    fix = repairs.select(*by, "n", F.struct("start", "end").alias("_fix"))
    held = projected.join(fix, [*by, "n"], "left")
    merged = F.col("state") == "merged"
    state = F.when(merged, F.when(F.col("_fix").isNotNull(), "one_repair").otherwise("fallback")).otherwise(F.col("state"))
    late = F.when(merged & F.col("_fix").isNull(), F.concat("warnings", F.array(F.lit("repair_failed")))).otherwise(F.col("warnings"))
    changed = {
        "start": F.when(merged, F.coalesce("_fix.start", "start")).otherwise(F.col("start")), "end": F.when(merged, F.coalesce("_fix.end", "end")).otherwise(F.col("end")), "state": state,
        "states": F.when(merged, F.concat("states", F.array(state))).otherwise(F.col("states")), "warnings": late,
    }
    return held.select(*[changed.get(c, F.col(c)).alias(c) for c in projected.columns])
