"""Packing into length buckets that minimise padding, with token-budget batches inside each bucket.

The global histogram of lengths is exact; it has no more entries than the longest document has tokens, whatever the
corpus. A dynamic programme over it places the bucket boundaries so that the padded tokens in all are fewest.

Defined cases: a null text has 0 tokens and pads to its bucket like any other; a document longer than
the budget is a batch of its own; equal rows are interchangeable; an empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, stage, words_in

BUCKETS = 16
TOKEN_BUDGET = 65_536


def boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding over the histogram.

    The cost obeys the quadrangle inequality, so the best cut moves up with the end. A layer is solved by halving: the ends of
    one depth are solved at once, each over the cuts between those of its neighbours of the depth before.
    """
    order = np.argsort(lengths, kind="stable")
    x, c = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    m = len(x)
    if m == 0:
        return []
    many, words = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    # best[j]: least padding of the first j entries in the layers so far
    best = np.concatenate([[0.0], x * many[1:] - words[1:]])
    cuts = [np.zeros(m + 1, np.int64)]
    for layer in range(2, min(buckets, m) + 1):
        now, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        lo, hi, a, b = (np.array([v]) for v in (layer, m, layer - 1, m - 1))
        while len(lo):
            j = (lo + hi) // 2
            last = np.minimum(b, j - 1)
            size = last - a + 1
            starts = np.cumsum(size) - size
            i = np.arange(int(size.sum())) - np.repeat(starts - a, size)
            end = np.repeat(j, size)
            cost = best[i] + x[end - 1] * (many[end] - many[i]) - (words[end] - words[i])
            least = np.minimum.reduceat(cost, starts)
            hits = np.flatnonzero(cost == np.repeat(least, size))
            first = np.searchsorted(hits, starts)
            at = i[hits[first]]
            now[j], cut[j] = least, at
            lo, hi, a, b = np.concatenate([lo, j + 1]), np.concatenate([j - 1, hi]), np.concatenate([a, at]), np.concatenate([at, b])
            open_ = lo <= hi
            lo, hi, a, b = lo[open_], hi[open_], a[open_], b[open_]
        best = now
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        out.append(int(x[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, tokens: Column | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_tokens, bucket, bucket_tokens (padded length), batch (within the bucket) and slot (within the batch)."""
    count = words_in(F.col("text")) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    sized = stage(docs.select(*keep, count.alias("n_tokens")), "pack-sizes")
    hist = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()  # one entry a length
    ends = boundaries(hist.column(0).to_numpy(), hist.column(1).to_numpy(), buckets)
    at = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array().cast("array<long>")
    bucket = F.size(F.filter(at, lambda e: e < F.col("n_tokens")))
    placed = sized.withColumn("bucket", bucket.cast("int")).withColumn("bucket_tokens", F.try_element_at(at, F.col("bucket") + 1))
    order = [*keep, "n_tokens"]
    out = ranked(placed, ["bucket"], order, "_at")
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    return out.withColumn("batch", F.floor(F.col("_at") / per).cast("long")).withColumn("slot", F.pmod(F.col("_at"), per).cast("int")).drop("_at")
