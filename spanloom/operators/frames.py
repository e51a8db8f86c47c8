"""Energy operators on frame tables (by, k, t0, t1, rms, db) with k counting frames from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def runs_where(frames: DataFrame, by: Sequence[str], cond: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` frames in a row that meet ``cond``: by, k0, k1, t0, t1, frames."""
    hit = frames.where(cond).withColumn("_r", F.col("k") - F.row_number().over(W.partitionBy(*by).orderBy("k")))
    run = hit.groupBy(*by, "_r").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count(F.lit(1)).alias("frames"))
    return run.where(F.col("frames") >= least).drop("_r")


def voiced(frames: DataFrame, by: Sequence[str], threshold: float, hangover: int, least: int) -> DataFrame:
    """Runs of loud frames; pauses shorter than ``hangover`` frames belong to them, runs under ``least`` frames are left out."""
    loud = frames.where(F.col("rms") > threshold)
    w = W.partitionBy(*by).orderBy("k")
    marked = loud.withColumn("_n", F.coalesce((F.col("k") - F.lag("k").over(w) - 1 >= hangover).cast("int"), F.lit(0)))
    run = marked.withColumn("_r", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(*by, "_r")
    out = run.agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return out.withColumn("frames", F.col("k1") - F.col("k0") + 1).where(F.col("frames") >= least).drop("_r")


def inverted(silences: DataFrame, lengths: DataFrame, by: Sequence[str], least: float) -> DataFrame:
    """Speech between silences (t0, t1) inside [0, seconds] of each key, pieces under ``least`` left out; a key without silences is one piece."""
    w = W.partitionBy(*by).orderBy("t0", "t1")
    before = silences.select(*by, F.coalesce(F.lag("t1").over(w), F.lit(0.0)).alias("p0"), F.col("t0").alias("p1"))
    tail = lengths.join(silences.groupBy(*by).agg(F.max_by("t1", F.struct("t0", "t1")).alias("_e")), [*by], "left").select(*by, F.coalesce("_e", F.lit(0.0)).alias("p0"), F.col("seconds").alias("p1"))
    return before.unionByName(tail).where(F.col("p1") - F.col("p0") >= least)


def noise_floor(frames: DataFrame, by: Sequence[str], share: float = 0.2, every: int = 10, floor: float = 0.00025) -> DataFrame:
    """The rms at rank int(n * share) of every ``every``-th frame, not interpolated and at least ``floor``."""
    w = W.partitionBy(*by)
    ranked = frames.where(F.col("k") % every == 0).withColumn("_k", F.row_number().over(w.orderBy("rms")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_k") == F.floor(F.col("_n") * share)).select(*by, F.greatest("rms", F.lit(floor)).alias("floor"))


def quietest(frames: DataFrame, ranges: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """For each range (id, k0, k1) the quietest frame in it, the first at a tie: id, at, rms. Frames meet ranges in buckets of ``width`` frames."""
    f = frames.withColumn("_b", F.floor(F.col("k") / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("k0") / width), F.floor(F.col("k1") / width))))
    met = r.join(f.select(*by, "_b", "k", "rms"), [*by, "_b"]).where(F.col("k").between(F.col("k0"), F.col("k1")))
    return met.groupBy("id").agg(F.min_by("k", F.struct("rms", "k")).alias("at"), F.min("rms").alias("rms"))


def edge_ratio(frames: DataFrame, by: Sequence[str], near: int = 3) -> DataFrame:
    """Mean rms of the ``near`` frames from each frame on over that of as many before it; null at the start."""
    w = W.partitionBy(*by).orderBy("k")
    after, before = F.avg("rms").over(w.rowsBetween(0, near - 1)), F.avg("rms").over(w.rowsBetween(-near, -1))
    return frames.withColumn("ratio", after / F.greatest(before, F.lit(1e-10)))


def pad_by_slope(slope: Column) -> Column:
    """Padding in seconds: the steeper an edge, the less."""
    return F.when(slope > 8, 0.05).when(slope > 3, 0.10).when(slope > 1.5, 0.15).otherwise(0.20)


def bursts(frames: DataFrame, by: Sequence[str], around: int, times: float, most: int) -> DataFrame:
    """Runs of at most ``most`` frames louder than ``times`` the median of ``around`` frames on both sides."""
    w = W.partitionBy(*by).orderBy("k").rowsBetween(-around, around)
    marked = frames.withColumn("_m", F.percentile("rms", F.lit(0.5)).over(w))
    return runs_where(marked, by, F.col("rms") > times * F.col("_m"), 1).where(F.col("frames") <= most)


def _quantile(ordered: Column, share: float) -> Column:
    """Of a sorted array, between its neighbours where it falls between two."""
    at = (F.size(ordered) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (at - low)


def noise_profile(
    frames: DataFrame, by: Sequence[str], hop: float, window: int = 4, least: int = 4, close_db: float = 3.0, shortest: float = 2.0, fallback_db: float = -35.0, floor: float = 1e-6, ceiling: float = 0.5, most: int | None = None,
) -> DataFrame:
    """Noise of recordings as intervals (t0, t1, rms, mad, db, stable, frames) from frames (k from 0, rms) every ``hop`` seconds.

    Windows of ``window`` frames start every half window. A window's noise is the lower quartile of its decibels (``fallback_db`` under ``least``
    frames, then not stable); rms is the median and mad 1.4826 times the median deviation. A window within ``close_db`` of the interval so far joins
    it, means being weighted by frames; another one begins an interval if it ends ``shortest`` after it or is the last, else it is passed over. A
    recording shorter than ``shortest`` is one fallback interval. ``most``: windows of a recording that are looked at (all, if not given).
    """
    step = max(1, window // 2)
    x = frames.select(*by, "k", F.greatest(F.lit(floor), F.least(F.lit(ceiling), F.col("rms"))).alias("rms"))
    last = F.floor(F.col("k") / step).cast("long")
    starts = F.filter(F.sequence(F.greatest(F.lit(0).cast("long"), last - -(-window // step)), last), lambda s: s * step + window > F.col("k"))
    placed = x.withColumn("n", F.explode(starts))
    placed = placed if most is None else placed.where(F.col("n") < most)
    g = placed.groupBy(*by, "n").agg(F.array_sort(F.collect_list("rms")).alias("r"), F.max("k").alias("top"))
    median = _quantile(F.col("r"), 0.5)
    g = g.withColumn("_m", median).withColumn("_d", F.array_sort(F.transform("r", lambda v: F.abs(v - F.col("_m")))))
    size = F.size("r")
    db = _quantile(F.transform("r", lambda v: 20.0 * F.log10(v)), 0.25)
    rows = g.select(
        *by, "n", (F.col("n") * step * F.lit(hop)).alias("t0"), ((F.col("n") * step + size) * F.lit(hop)).alias("t1"), F.col("_m").alias("rms"), F.when(size > 1, _quantile(F.col("_d"), 0.5) * 1.4826).otherwise(0.0).alias("mad"),
        F.when(size >= least, db).otherwise(F.lit(fallback_db)).alias("db"), (size >= least).alias("stable"), size.cast("long").alias("frames"), F.col("top"),
    )
    fields = ("t0", "t1", "rms", "mad", "db", "stable", "frames")
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", *fields))).alias("w"), ((F.max("top") + 1) * F.lit(hop)).alias("long"))
    lists = lists.withColumn("w", F.transform("w", lambda i: F.struct(*[i[f] for f in fields], (i["n"] == F.element_at("w", -1)["n"]).alias("final"))))
    shape = F.slice("w", F.lit(1), F.lit(1))

    def join(a: Column, b: Column) -> Column:
        n = a["frames"] + b["frames"]
        mean = lambda c: ((a[c] * a["frames"] + b[c] * b["frames"]) / n).alias(c)
        return F.struct(a["t0"].alias("t0"), b["t1"].alias("t1"), mean("rms"), F.greatest(a["mad"], b["mad"]).alias("mad"), mean("db"), (a["stable"] & b["stable"]).alias("stable"), n.alias("frames"), b["final"].alias("final"))

    def fold(out: Column, i: Column) -> Column:
        prev = F.element_at(out, -1)
        near, far = F.abs(i["db"] - prev["db"]) < close_db, (i["t1"] - prev["t1"] >= shortest) | i["final"]
        return F.when(near, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(join(prev, i)))).when(far, F.concat(out, F.array(i))).otherwise(out)

    folded = F.aggregate(F.slice("w", F.lit(2), F.size("w")), shape, fold)
    brief = F.array(F.struct(
        F.lit(0.0).alias("t0"), F.col("long").alias("t1"), F.lit(floor).alias("rms"), F.lit(0.0).alias("mad"), F.lit(fallback_db).alias("db"), F.lit(False).alias("stable"), F.lit(0).cast("long").alias("frames"), F.lit(True).alias("final"),
    ))
    return lists.select(*by, F.inline(F.when(F.col("long") < shortest, brief).otherwise(folded))).drop("final")
