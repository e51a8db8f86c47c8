"""Operators on event tables: single owners, group merge reasons, display times, segment mapping, impact and covariance distances."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import events as ev
from . import intervals as iv

#: Percent by which a measure moves for a percent of a parameter.
IMPACT: Mapping[str, Mapping[str, float]] = {
    "merging.padding": {"avg_duration": 0.8, "end_truncation": -1.2, "total_lines": -0.3},
    "merging.padding_max": {"avg_duration": 0.4, "end_truncation": -0.6},
    "merge_decision.fast_merge_max_gap": {"merge_frequency": 1.5, "avg_duration": 0.6, "total_lines": -0.5},
    "merge_decision.llm_decision_max_gap": {"merge_frequency": 0.8, "split_frequency": -1.0, "avg_duration": 0.4},
    "merge_decision.llm_decision_min_gap": {"merge_frequency": 0.6, "split_frequency": -0.5},
    "merge_decision.hard_split_min_gap": {"split_frequency": 0.4, "merge_frequency": -0.3},
    "subtitle.max_duration": {"avg_duration": 0.9, "total_lines": -0.4, "merge_frequency": 0.3},
    "subtitle.max_chars_cjk": {"avg_duration": 0.5, "total_lines": -0.3},
}


def only_owner(ranges: DataFrame, clips: DataFrame, by: Sequence[str], width: float) -> DataFrame:
    """(id, clip) of the ranges that overlap one clip and no other."""
    met = iv.overlap_join(ranges, clips, by, width)
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("r_id").alias("clip")).where("n = 1").select("id", "clip")


def merge_fault(events: DataFrame, by: Sequence[str], max_gap: float = 0.12, max_duration: float = 5.0) -> DataFrame:
    """Per group ``by`` of events (start, end, split_before, bin, speaker, confirmed, overlap): why it may not merge; null if it may."""
    w = W.partitionBy(*by).orderBy("start", "end")
    seen = events.withColumn("_gap", F.lead("start").over(w) - F.col("end")).withColumn("_first", F.row_number().over(w) == 1)
    known = F.when(F.col("confirmed"), F.col("speaker"))
    last = F.max(F.struct("start", "end"))["end"]
    facts = seen.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("split_before") & ~F.col("_first")).alias("split"), (F.min("bin") < F.max("bin")).alias("bins"), (F.min(known) < F.max(known)).alias("speakers"),
        F.bool_or("overlap").alias("tracks"), (F.max("_gap") > max_gap).alias("gap"), (last - F.min("start") > max_duration).alias("long"),
    )
    fault = F.when(F.col("n") < 2, None)
    for name in ("split", "bins", "speakers", "tracks", "gap", "long"):
        fault = fault.when(F.col(name), name)
    return facts.select(*by, fault.alias("fault"))


def next_mergeable(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """``groups`` (start, id, speaker, region, split_before, split_after) with whether each may join the one after it."""
    w = W.partitionBy(*by).orderBy("start", "id")
    nxt = {c: F.lead(c).over(w) for c in ("id", "speaker", "region", "split_before")}
    ok = nxt["id"].isNotNull() & F.coalesce(F.col("speaker") == nxt["speaker"], F.lit(True)) & F.coalesce(F.col("region") == nxt["region"], F.lit(True))
    return groups.withColumn("mergeable", ok & ~F.coalesce(F.col("split_after") | nxt["split_before"], F.lit(False)))


def display_times(groups: DataFrame, by: Sequence[str], duration: Column, lead: float = 0.15, trail: float = 0.15, reading: float = 0.6) -> DataFrame:
    """``groups`` (start, end, from, to, degraded, speaker, id) with show, hide and conflict.

    ``from`` and ``to`` are projected times. A cue is shown from ``lead`` before its projection to ``trail`` after it within its physical
    span, over the whole span unless its timing is degraded, and for ``reading`` seconds at least where the recording lasts.
    """
    a, b = F.greatest("start", F.col("from") - lead), F.least("end", F.col("to") + trail)
    a, b = F.when(F.col("degraded"), a).otherwise(F.least(a, F.col("start"))), F.when(F.col("degraded"), b).otherwise(F.greatest(b, F.col("end")))
    b = F.when(b - a < reading, F.least(a + reading, duration)).otherwise(b)
    a, b = F.greatest(F.lit(0.0), a), F.least(duration, b)
    timed = groups.withColumn("show", a).withColumn("hide", F.when(b <= a, a + reading).otherwise(b))
    w = W.partitionBy(*by).orderBy("start", "id")
    clash = (F.lag("speaker").over(w) != F.col("speaker")) & (F.col("show") < F.lag("hide").over(w))
    timed = timed.withColumn("conflict", F.coalesce(clash, F.lit(False)))
    return timed.withColumn("show", F.greatest(F.lit(0.0), F.when(F.col("conflict"), F.least("show", "start")).otherwise(F.col("show"))))


def segments_to_timeline(segments: DataFrame, by: Sequence[str], slack: float = 0.15) -> DataFrame:
    """Local segments (n, start, end, first, last, offset, stop) of regions ``by`` to global events (start, end).

    A segment's words (``first``, ``last``) go before its own times; the last segment of a region ends with it; an event may
    pass its region's end by ``slack``; empty ones go.
    """
    last = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"))) == 1
    start = F.col("offset") + F.coalesce("first", "start")
    end = F.when(last, F.col("stop")).otherwise(F.col("offset") + F.coalesce("last", "end"))
    ended = segments.withColumn("_a", start).withColumn("_b", end)
    b = F.least(F.col("_b"), F.greatest(F.col("stop"), F.col("_b") - 0.05) + slack)
    return ended.withColumn("start", F.col("_a")).withColumn("end", b).drop("_a", "_b").where(F.col("end") > F.col("start"))


def duplicate_pairs(words: DataFrame, by: Sequence[str], width: float, share: float = 0.5, tolerance: float = 0.08) -> DataFrame:
    """(left, right) ids of words with equal keys ``by`` that overlap by ``share`` of the shorter one, less ``tolerance``."""
    wide = words.withColumn("t1", F.col("t1") + tolerance)
    met = iv.overlap_join(wide, wide, by, width).where(F.col("id") < F.col("r_id"))
    own, other = F.col("t1") - tolerance, F.col("r_t1") - tolerance
    shared = F.least(own, other) - F.greatest("t0", "r_t0")
    shortest = F.least(own - F.col("t0"), other - F.col("r_t0"))
    return met.where((shared >= -tolerance) & (shared >= shortest * share - tolerance)).select(F.col("id").alias("left"), F.col("r_id").alias("right"))


def degraded(runs: DataFrame, dims: Sequence[str], most: float = 0.10) -> DataFrame:
    """(dim, change) of the measures whose mean in trial runs (``t_`` columns) is under that in current ones by more than ``most``; runs with both above 0 count."""
    rows = runs.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("now"), F.col("t_" + d).cast("double").alias("trial")) for d in dims])).alias("x")).select("x.*")
    means = rows.where("now > 0 and trial > 0").groupBy("dim").agg(F.avg("now").alias("now"), F.avg("trial").alias("trial"))
    return means.select("dim", ((F.col("trial") - F.col("now")) / F.col("now")).alias("change")).where(F.col("change") < -most)


def impact(adjustments: DataFrame) -> DataFrame:
    """``adjustments`` (param, value, delta) with the percent by which each measure of its parameter moves: one row a measure."""
    spark = adjustments.sparkSession
    table = spark.createDataFrame([(p, m, c) for p, ms in IMPACT.items() for m, c in ms.items()], "param string, measure string, coefficient double")
    pct = F.when(F.col("value") > 0, F.col("delta") / F.col("value") * 100).otherwise(0.0)
    return adjustments.join(F.broadcast(table), "param").withColumn("change", pct * F.col("coefficient")).drop("coefficient")  # the table of IMPACT


class CovarianceDistance:
    """Distance under the covariance of standardised vectors; their sums come from one pass, d * d numbers a partition."""

    def __init__(self, n: int, total: np.ndarray, products: np.ndarray, ridge: float = 1e-6):
        mean, cross = total / n, products / n
        dev = np.sqrt(np.maximum(np.diag(cross) - mean**2, 0))
        self.mean, self.dev = mean, np.where(dev > 0, dev, 1.0)
        centred = (cross - np.outer(mean, mean)) / np.outer(self.dev, self.dev) * (n / max(n - 1, 1))
        self.inverse = np.linalg.inv(centred + ridge * np.eye(len(mean)))

    @classmethod
    def fit(cls, vectors: DataFrame, column: str, dims: int, ridge: float = 1e-6) -> CovarianceDistance | None:
        """From the vectors of ``dims`` numbers; None for fewer than two."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, products = 0, np.zeros(dims), np.zeros((dims, dims))
            for b in batches:
                x = np.array([v for v in b.column(0).to_pylist() if v is not None and len(v) == dims and all(e is not None for e in v)], float).reshape(-1, dims)
                n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array([[float(n), *total, *products.ravel()]])], ["sums"])

        parts = vectors.select(F.col(column).cast("array<double>")).mapInArrow(sums, "sums array<double>")
        added = parts.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()  # 1 + dims + dims * dims numbers
        if not added or added[0].x < 2:
            return None
        r = np.array([a.x for a in added])
        return cls(int(r[0]), r[1 : dims + 1], r[dims + 1 :].reshape(dims, dims), ridge)

    def add_distance(self, pairs: DataFrame, a: str, b: str | None = None, name: str = "distance") -> DataFrame:
        """``pairs`` with the distance of two vector columns, or of one from the mean."""
        mean, dev, inverse = self.mean, self.dev, self.inverse

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column(batch.schema.get_field_index(a)).to_pylist(), float).reshape(batch.num_rows, len(mean))
                y = mean if b is None else np.array(batch.column(batch.schema.get_field_index(b)).to_pylist(), float).reshape(batch.num_rows, len(mean))
                d = (x - y) / dev
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inverse, d), 0)))], [*batch.schema.names, name])

        return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField(name, T.DoubleType())]))

    @staticmethod
    def similarity(distance: Column, dims: int) -> Column:
        return ev.covariance_similarity(distance, dims)
