"""Coalescing of intervals: gaps and islands by window functions, order-dependent rules by folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _islands(df: DataFrame, by: Sequence[str], breaks: Column) -> DataFrame:
    w = W.partitionBy(*by).orderBy("t0", "t1", "id")
    return df.withColumn("_new", breaks.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def coalesce_reach(spans: DataFrame, by: Sequence[str], gap: float) -> DataFrame:
    """Runs whose next start is within ``gap`` of the furthest end so far."""
    w = W.partitionBy(*by).orderBy("t0", "t1", "id").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("t1").over(w)
    marked = spans.withColumn("_reach", reach)
    return _fold(_islands(marked, by, F.col("_reach").isNull() | (F.col("t0") - F.col("_reach") > gap)), by)


def coalesce_previous(spans: DataFrame, by: Sequence[str], gap: float) -> DataFrame:
    """Runs whose next start is within ``gap`` of the end of the row just before."""
    w = W.partitionBy(*by).orderBy("t0", "t1", "id")
    marked = spans.withColumn("_end", F.lag("t1").over(w))
    return _fold(_islands(marked, by, F.col("_end").isNull() | (F.col("t0") - F.col("_end") > gap)), by)


def same_speaker_runs(spans: DataFrame, by: Sequence[str], gap: float) -> DataFrame:
    """Neighbours merge if they have the same known speaker and 0 <= gap <= ``gap``."""
    w = W.partitionBy(*by).orderBy("t0", "t1", "id")
    marked = spans.withColumn("_end", F.lag("t1").over(w)).withColumn("_who", F.lag("speaker").over(w))
    between = F.col("t0") - F.col("_end")
    joins = (F.col("speaker") == F.col("_who")) & (between >= 0) & (between <= gap)
    runs = _islands(marked, by, ~F.coalesce(joins, F.lit(False)))
    return runs.groupBy(*by, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max("speaker").alias("speaker"), F.count(F.lit(1)).alias("members")).drop("island")


def _fold(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    return runs.groupBy(*by, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count(F.lit(1)).alias("members")).drop("island")


def stitch_next(spans: DataFrame, by: Sequence[str], gap: float) -> DataFrame:
    """A span ends where the next one of the same or an unknown speaker starts, if 0 < gap <= ``gap``."""
    w = W.partitionBy(*by).orderBy("t0", "t1", "id")
    nxt, who = F.lead("t0").over(w), F.lead("speaker").over(w)
    marked = spans.withColumn("_n", nxt).withColumn("_who", who)
    close = (F.col("_n") - F.col("t1") > 0) & (F.col("_n") - F.col("t1") <= gap) & F.coalesce(F.col("speaker") == F.col("_who"), F.lit(True))
    return marked.withColumn("t1", F.when(close, F.col("_n")).otherwise(F.col("t1"))).drop("_n", "_who")


def check_ends(spans: DataFrame, by: Sequence[str], least: float, close: float) -> DataFrame:
    """Ends before starts and spans under ``least`` get that length; gaps under ``close`` vanish."""
    fixed = spans.withColumn("t1", F.greatest("t1", F.col("t0") + least))
    nxt = F.lead("t0").over(W.partitionBy(*by).orderBy("t0", "t1", "id"))
    gap = F.col("_n") - F.col("t1")
    return fixed.withColumn("_n", nxt).withColumn("t1", F.when((gap > 0) & (gap < close), F.col("_n")).otherwise(F.col("t1"))).drop("_n")


def unknown_runs(spans: DataFrame, by: Sequence[str], longest: float, gap: float) -> DataFrame:
    """Runs without a speaker between two runs of one speaker inherit it if short and near."""
    w = W.partitionBy(*by).orderBy("t0", "t1", "id")
    before, after = F.last("speaker", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.first("speaker", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    known = F.when(F.col("speaker").isNotNull(), F.col("t1"))
    end_before = F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    start_after = F.first(F.when(F.col("speaker").isNotNull(), F.col("t0")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    run = F.count("speaker").over(w.rowsBetween(W.unboundedPreceding, 0))
    r = spans.withColumn("_a", before).withColumn("_z", after).withColumn("_ea", end_before).withColumn("_sz", start_after).withColumn("_run", run)
    part = W.partitionBy(*by, "_run", F.col("speaker").isNull())
    r = r.withColumn("_lo", F.min("t0").over(part)).withColumn("_hi", F.max("t1").over(part))
    fits = F.col("speaker").isNull() & (F.col("_a") == F.col("_z")) & (F.col("_hi") - F.col("_lo") <= longest) & (F.col("_lo") - F.col("_ea") <= gap) & (F.col("_sz") - F.col("_hi") <= gap)
    return r.withColumn("speaker", F.when(fits, F.col("_a")).otherwise(F.col("speaker"))).drop("_a", "_z", "_ea", "_sz", "_run", "_lo", "_hi")


def split_long(spans: DataFrame, longest: float) -> DataFrame:
    """Equal pieces of at most ``longest`` seconds."""
    n = F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / longest)).cast("int")
    cut = spans.withColumn("pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    step = (F.col("t1") - F.col("t0")) / F.col("pieces")
    return cut.withColumn("p0", F.col("t0") + step * F.col("piece")).withColumn("p1", F.col("t0") + step * (F.col("piece") + 1))


def start_dedup(spans: DataFrame, by: Sequence[str], near: float) -> DataFrame:
    """Drop a span that starts within ``near`` of the one just before it."""
    w = W.partitionBy(*by).orderBy("t0", "t1", "id")
    return spans.withColumn("_p", F.lag("t0").over(w)).where(F.col("_p").isNull() | (F.col("t0") - F.col("_p") > near)).drop("_p")


def grid_vote(spans: DataFrame, by: Sequence[str], cell: float, votes: int) -> DataFrame:
    """Grid cells that at least ``votes`` different speakers cover, as runs."""
    cells = F.sequence(F.floor(F.col("t0") / cell).cast("long"), (F.greatest(F.ceil(F.col("t1") / cell), F.floor(F.col("t0") / cell) + 1) - 1).cast("long"))
    per = spans.select(*by, "speaker", F.explode(cells).alias("cell")).distinct().groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= votes)
    run = F.col("cell") - F.row_number().over(W.partitionBy(*by).orderBy("cell"))
    runs = per.withColumn("_run", run).groupBy(*by, "_run").agg(F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"), F.max("n").alias("most_votes"))
    return runs.drop("_run")


def word_events(words: DataFrame, by: Sequence[str], least: float, most: float) -> DataFrame:
    """Consecutive words of one speaker whose gap lies in [least, most] are one event."""
    w = W.partitionBy(*by).orderBy("t0", "t1", "id")
    marked = words.withColumn("_e", F.lag("t1").over(w)).withColumn("_w", F.lag("speaker").over(w))
    gap = F.col("t0") - F.col("_e")
    runs = _islands(marked, by, F.col("_e").isNull() | ~F.col("speaker").eqNullSafe(F.col("_w")) | (gap < least) | (gap > most))
    return runs.groupBy(*by, "island").agg(F.max("speaker").alias("speaker"), F.count(F.lit(1)).alias("words"), F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("island")


def close_gaps(spans: DataFrame, by: Sequence[str], gap: float) -> DataFrame:
    """A span ends 1 ms before the next one if the gap is within ``gap`` and both have one speaker (none equals none)."""
    w = W.partitionBy(*by).orderBy("t0", "t1", "id")
    marked = spans.withColumn("_n", F.lead("t0").over(w)).withColumn("_w", F.lead("speaker").over(w))
    near = (F.col("_n") > F.col("t1")) & (F.col("_n") - F.col("t1") <= gap) & F.col("speaker").eqNullSafe(F.col("_w"))
    return marked.withColumn("t1", F.when(near, F.col("_n") - 0.001).otherwise(F.col("t1"))).drop("_n", "_w")


def overlap_groups(spans: DataFrame, by: Sequence[str], tracks: int) -> DataFrame:
    """Runs of overlapping spans as one row: of the first ``tracks`` members, the first of each speaker; runs with one speaker are left out."""
    w = W.partitionBy(*by).orderBy("t0", "t1", "id").rowsBetween(W.unboundedPreceding, -1)
    marked = spans.withColumn("_e", F.max("t1").over(w))
    runs = _islands(marked, by, F.col("_e").isNull() | (F.col("t0") >= F.col("_e")))
    order = ("t0", "t1", "id")
    head = runs.withColumn("_k", F.row_number().over(W.partitionBy(*by, "island").orderBy(*order))).where(F.col("_k") <= tracks)
    head = head.withColumn("_m", F.row_number().over(W.partitionBy(*by, "island", "speaker").orderBy(*order))).where("_m = 1")
    lines = F.array_sort(F.collect_list(F.struct(*order, "speaker")))
    g = head.groupBy(*by, "island").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("tracks"), lines.alias("_l"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return g.where("tracks > 1").withColumn("label", F.array_join(F.col("_l.speaker"), " | ")).drop("_l", "island")


def macro_chunks(spans: DataFrame, by: Sequence[str], silence: float, margin: float) -> DataFrame:
    """Chunks between the middles of silences of ``silence`` or more, each ``margin`` longer on both sides but inside the envelope."""
    gap = F.lead("t0").over(W.partitionBy(*by).orderBy("t0", "t1", "id")) - F.col("t1")
    ends = spans.groupBy(*by).agg(F.min("t0").alias("_a"), F.max("t1").alias("_b"))
    cuts = spans.withColumn("_g", gap).where(F.col("_g") >= silence).select(*by, (F.col("t1") + F.col("_g") / 2).alias("x"))
    w = W.partitionBy(*by).orderBy("x")
    chunk = cuts.unionByName(ends.select(*by, F.col("_a").alias("x"))).join(ends, [*by]).withColumn("_y", F.lead("x").over(w))
    return chunk.select(*by, F.greatest("_a", F.col("x") - margin).alias("c0"), F.when(F.col("_y").isNull(), F.col("_b")).otherwise(F.least("_b", F.col("_y") + margin)).alias("c1"))


def drop_runs(spans: DataFrame, by: Sequence[str], value: str, drop: float, least: int) -> DataFrame:
    """Runs of at least ``least`` rows where the mean of the two values before exceeds that of the three from here by more than ``drop``."""
    w = W.partitionBy(*by).orderBy("t0", "t1", "id")
    fall = F.avg(value).over(w.rowsBetween(-2, -1)) - F.avg(value).over(w.rowsBetween(0, 2))
    rows = spans.withColumn("_d", fall).withColumn("_k", F.row_number().over(w)).where(F.col("_d") > drop)
    run = rows.withColumn("_r", F.col("_k") - F.row_number().over(W.partitionBy(*by).orderBy("_k")))
    return run.groupBy(*by, "_r").agg(F.min("_k").alias("first_row"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("_r")
