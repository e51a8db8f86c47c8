"""Joins over intervals [t0, t1) that share the keys ``by``.

A range join is an equi join on time buckets: each interval is listed in every bucket of ``width`` seconds that it
touches, and a pair counts only in the later of their first buckets, so no pair repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _bucketed(df: DataFrame, width: float) -> DataFrame:
    first, last = F.floor(F.col("t0") / width), F.floor(F.greatest("t0", "t1") / width)
    return df.withColumn("_first", first.cast("long")).withColumn("_b", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def overlap_join(left: DataFrame, right: DataFrame, by: Sequence[str], width: float, extra: Column | None = None) -> DataFrame:
    """Pairs with l.t0 < r.t1 and r.t0 < l.t1; the right side's other columns get the prefix r_."""
    rb = _bucketed(right, width).select(*by, "_b", F.col("_first").alias("r__first"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    lb = _bucketed(left, width)
    joined = lb.join(rb, [*by, "_b"]).where((F.col("t0") < F.col("r_t1")) & (F.col("r_t0") < F.col("t1")) & (F.col("_b") == F.greatest("_first", "r__first")))
    if extra is not None:
        joined = joined.where(extra)
    return joined.drop("_b", "_first", "r__first")


def overlap_exists(left: DataFrame, right: DataFrame, by: Sequence[str], width: float, anti: bool = False, extra: Column | None = None) -> DataFrame:
    """Rows of ``left`` that overlap some row of ``right``, or none; repeated and null ids are rows of their own.

    Rows are known by their values and counted, not numbered, so both uses of ``left`` agree whatever order its rows come in. Columns
    must be comparable (no maps).
    """
    counted = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("_n"))
    hit = overlap_join(counted, right, by, width, extra=extra).select(*left.columns, "_n").distinct()
    if anti:
        theirs = hit.toDF(*[f"_h_{c}" for c in hit.columns])
        hit = counted.join(theirs, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in left.columns], "left_anti")
    return hit.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")


def overlap_seconds() -> Column:
    return F.least("t1", "r_t1") - F.greatest("t0", "r_t0")


def best_overlap(left: DataFrame, right: DataFrame, by: Sequence[str], width: float, extra=None) -> DataFrame:
    """id and the right id with the largest overlap; ties to the nearer midpoint, then the larger id."""
    pairs = overlap_join(left, right, by, width, extra=extra)
    away = F.abs((F.col("t0") + F.col("t1")) / 2 - (F.col("r_t0") + F.col("r_t1")) / 2)
    return pairs.groupBy("id").agg(F.max_by("r_id", F.struct(overlap_seconds(), -away, "r_id")).alias("best_id"), F.max(overlap_seconds()).alias("best_overlap"))


def stab_join(points: DataFrame, spans: DataFrame, by: Sequence[str], width: float) -> DataFrame:
    """Points (id, t) with the spans that contain them (closed)."""
    p = points.withColumn("_b", F.floor(F.col("t") / width).cast("long"))
    s = _bucketed(spans, width).drop("_first")
    s = s.select(*by, "_b", *[F.col(c).alias(f"r_{c}") for c in spans.columns if c not in by])
    return p.join(s, [*by, "_b"]).where((F.col("r_t0") <= F.col("t")) & (F.col("t") <= F.col("r_t1"))).drop("_b")


def asof_neighbours(points: DataFrame, spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each point (id, t): prev_end, the latest span end before t, and next_start, the first span start after t.

    One sorted union per key instead of a range join.
    """
    cols = [*by, "t", "kind", "id"]
    rows = (
        points.select(*by, "t", F.lit(1).alias("kind"), "id")
        .unionByName(spans.select(*by, F.col("t1").alias("t"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("id")))
        .unionByName(spans.select(*by, F.col("t0").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id")))
    ).select(*cols)
    # at equal times a start stands before the point and an end after it, so both are strict
    w = W.partitionBy(*by).orderBy("t", "kind")
    back = F.max(F.when(F.col("kind") == 2, F.col("t"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("kind") == 0, F.col("t"))).over(w.rowsBetween(1, W.unboundedFollowing))
    return rows.withColumn("prev_end", back).withColumn("next_start", ahead).where("kind = 1").select(*by, "id", "t", "prev_end", "next_start")


def complement(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """The gaps between the union of the spans of a key, inside its envelope."""
    w = W.partitionBy(*by).orderBy("t0", "t1").rowsBetween(W.unboundedPreceding, -1)
    reach = spans.withColumn("gap0", F.max("t1").over(w))
    return reach.where(F.col("gap0") < F.col("t0")).select(*by, "gap0", F.col("t0").alias("gap1"))


def cut_points(spans: DataFrame, cuts: DataFrame, by: Sequence[str], width: float) -> DataFrame:
    """Spans (id) cut at the times (t) of ``cuts`` strictly inside them: id, piece, t0, t1."""
    inside = stab_join(cuts.select(*by, "t").distinct().withColumn("id", F.lit(0)), spans, by, width)
    inside = inside.where((F.col("r_t0") < F.col("t")) & (F.col("t") < F.col("r_t1"))).groupBy("r_id").agg(F.collect_set("t").alias("ts"))
    whole = spans.join(inside.withColumnRenamed("r_id", "id"), "id", "left")
    ends = F.array_sort(F.concat(F.array("t0", "t1"), F.coalesce("ts", F.array().cast("array<double>"))))
    return whole.withColumn("_e", ends).select("id", *by, F.posexplode(F.arrays_zip(F.slice("_e", 1, F.size("_e") - 1).alias("a"), F.slice("_e", 2, F.size("_e") - 1).alias("b"))).alias("piece", "p")).select(
        "id", *by, "piece", F.col("p.a").alias("t0"), F.col("p.b").alias("t1")
    )


def concurrency(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Most spans open at once per key: starts and ends swept in time, ends first at equal times."""
    ends = spans.select(*by, F.col("t0").alias("t"), F.lit(1).alias("d")).unionByName(spans.select(*by, F.col("t1").alias("t"), F.lit(-1).alias("d")))
    w = W.partitionBy(*by).orderBy("t", "d").rowsBetween(W.unboundedPreceding, 0)
    return ends.withColumn("open", F.sum("d").over(w)).groupBy(*by).agg(F.max("open").alias("most_open"))


def reconcile(regions: DataFrame, turns: DataFrame, by: Sequence[str], width: float, collar: float = 0.08) -> DataFrame:
    """Regions (id) cut by the speaker turns over them: id, speaker, p0, p1; stretches that no turn covers have no speaker.

    Piece ends within ``collar`` of a region's end move onto it. Turns that overlap each other give overlapping pieces.
    """

    def snapped(t: Column) -> Column:
        return F.when(F.abs(t - F.col("t0")) <= collar, F.col("t0")).when(F.abs(t - F.col("t1")) <= collar, F.col("t1")).otherwise(t)

    regions = regions.where("t1 > t0").select("id", *by, "t0", "t1")
    pairs = overlap_join(regions, turns.where("t1 > t0").select("id", *by, "speaker", "t0", "t1"), by, width)
    pairs = pairs.withColumn("_p0", snapped(F.greatest("t0", "r_t0"))).withColumn("_p1", snapped(F.least("t1", "r_t1")))
    ends = F.when(F.col("_p1") > F.col("_p0"), F.col("_p1"))
    w = W.partitionBy("id").orderBy("r_t0", "r_t1", "r_id").rowsBetween(W.unboundedPreceding, -1)
    pairs = pairs.withColumn("_until", F.coalesce(F.max(ends).over(w), F.col("t0")))
    piece = lambda speaker, a, b: F.struct(speaker.alias("speaker"), a.alias("p0"), b.alias("p1"))
    nobody = F.lit(None).cast("string")
    inner = pairs.select("id", F.inline(F.array(
        piece(nobody, F.col("_until"), F.when(F.col("_p0") > F.col("_until") + 1e-6, F.col("_p0"))),
        piece(F.col("r_speaker"), F.col("_p0"), F.when(F.col("_p1") > F.col("_p0"), F.col("_p1"))),
    ))).where("p1 IS NOT NULL")
    until = pairs.groupBy("id").agg(F.max(ends).alias("_until"))
    tail = regions.join(until, "id", "left").withColumn("p0", F.coalesce("_until", "t0")).where(F.col("p0") < F.col("t1") - 1e-6)
    return inner.unionByName(tail.select("id", nobody.alias("speaker"), "p0", F.col("t1").alias("p1")))


def nearest_edge(points: DataFrame, spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each point (id, t): whether a span contains it (closed) and the distance to the nearest span, 0 inside; null if the key has none."""
    none = F.lit(None)
    rows = points.select(*by, "t", F.lit(1).alias("kind"), "id", none.cast("double").alias("e")).unionByName(
        spans.where("t1 >= t0").select(*by, F.col("t0").alias("t"), F.lit(0).alias("kind"), none.cast("long").alias("id"), F.col("t1").alias("e"))
    )
    w = W.partitionBy(*by).orderBy("t", "kind")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("kind") == 0, F.col("t"))).over(w.rowsBetween(1, W.unboundedFollowing))
    seen = rows.withColumn("_r", reach).withColumn("_a", ahead).where("kind = 1")
    inside = F.coalesce(F.col("_r") >= F.col("t"), F.lit(False))
    return seen.select(*by, "id", "t", inside.alias("inside"), F.when(inside, F.lit(0.0)).otherwise(F.least(F.col("t") - F.col("_r"), F.col("_a") - F.col("t"))).alias("distance"))


def ownership(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Disjoint clips: what overlaps goes to the earlier span; spans wholly inside earlier ones vanish."""
    w = W.partitionBy(*by).orderBy("t0", "t1", "id").rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("c0", F.greatest("t0", F.max("t1").over(w))).where(F.col("c0") < F.col("t1"))


def overlap_share(left: DataFrame, right: DataFrame, by: Sequence[str], width: float, extra: Column | None = None) -> DataFrame:
    """Seconds of each left span (id) under right spans over its length, at most 1; overlapping right spans count twice."""
    own = overlap_join(left, right, by, width, extra=extra).groupBy("id").agg(F.sum(overlap_seconds()).alias("_o"))
    long = F.col("t1") - F.col("t0")
    return left.join(own, "id", "left").withColumn("share", F.when(long <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.coalesce("_o", F.lit(0.0)) / long))).drop("_o")


def sliding(spans: DataFrame, length: float, step: float) -> DataFrame:
    """Windows of ``length`` every ``step`` inside each span, and one that ends with the span if the last stops short of it."""
    d = F.col("t1") - F.col("t0")
    n = F.greatest(F.floor((d - length) / step) + 1, F.lit(0)).cast("int")
    starts = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.col("t0") + i * step)
    short = (n == 0) | (F.col("t0") + (n - 1) * step + length < F.col("t1") - 1e-9)
    starts = F.when(short, F.concat(starts, F.array(F.greatest(F.col("t0"), F.col("t1") - length)))).otherwise(starts)
    return spans.select("*", F.posexplode(starts).alias("window", "w0")).withColumn("w1", F.least(F.col("w0") + length, F.col("t1")))


def timeline_errors(clips: DataFrame, evidence: DataFrame, by: Sequence[str]) -> DataFrame:
    """Broken rules as rows (rule, id): repeated ids, empty ranges, clips over an earlier clip, evidence of no clip or outside its clip."""
    many = clips.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated id").alias("rule"), "id")
    empty = clips.where("t1 <= t0").select(F.lit("empty range").alias("rule"), "id")
    w = W.partitionBy(*by).orderBy("t0", "t1", "id").rowsBetween(W.unboundedPreceding, -1)
    over = clips.withColumn("_r", F.max("t1").over(w)).where("t0 < _r").select(F.lit("overlap").alias("rule"), "id")
    owned = evidence.join(clips.select(F.col("id").alias("clip_id"), F.col("t0").alias("_c0"), F.col("t1").alias("_c1")), "clip_id", "left")
    lost = F.when(F.col("_c0").isNull(), "no clip").when((F.col("t0") < F.col("_c0")) | (F.col("t1") > F.col("_c1")), "outside its clip")
    strays = owned.withColumn("rule", lost).where("rule IS NOT NULL").select("rule", "id")
    return many.unionByName(empty).unionByName(over).unionByName(strays)
