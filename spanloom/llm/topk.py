"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Rows are packed into blocks; a block keeps one sorted list of its rows for each dimension. A query
walks the lists in step, from the end that its own component favours, and scores every row it meets
anew. The values at the present depth bound the score of any row not met; the walk stops when that
bound is under the k-th best score so far (rows of equal score still matter, as ties go to the smaller
id). The k-th best carries over from block to block inside a task. Queries are blocks too, and
every block of rows meets every block of queries.

Scores are exact integers: where a block's products may pass 2**53, doubles with a bound on their error choose the rows whose
scores are then summed in whole numbers. A score outside the range of a long stands as the end of that range, and ranks so.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do null
ids; a component whose 256-fold passes 2**500 in size stands as 2**500; an empty vector scores 0; a shorter vector counts as padded with zeros; rows with the query's id are
its own rows; a repeated query id is searched once, with its largest vector; empty tables give an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage

ROWS = 4096
QUERIES = 1024
#: Depth of the first look into the lists; each further one is twice as deep.
DEPTH = 16
#: Sums of products up to here are exact in doubles; range of a score.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class SortedLists:
    """A block of rows with its per-dimension lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order])
        self.up = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.up, axis=0)

    def bounds(self, q: np.ndarray, depth: int) -> np.ndarray:
        """For each query the best score that a row beyond ``depth`` can have."""
        low, high = self.sorted[depth], self.sorted[len(self.ids) - 1 - depth]
        most = np.maximum(q, 0) @ high + np.minimum(q, 0) @ low + self.slack(q, np.maximum(np.abs(high), np.abs(low)))
        return np.maximum(most, float(LEAST))

    def slack(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """By how much the products of q and x in doubles may be off, at most; 0 where they are exact."""
        size = np.abs(q) @ np.abs(x)
        return np.where(size < EXACT, 0.0, size * (q.shape[1] + 4) * 2.0**-52)

    def whole(self, q: np.ndarray, rows: np.ndarray) -> list[int]:
        """Exact scores of one query against some rows."""
        mine = [int(c) for c in q]
        return [min(MOST, max(LEAST, sum(a * int(b) for a, b in zip(mine, self.x[r], strict=True)))) for r in rows.tolist()]

    def search(self, own: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query (score, row position) that may be among its k best; ``kth``: its k-th best so far, -inf if fewer."""
        n = len(self.ids)
        out: list[list[tuple[int, int]]] = [[] for _ in q]
        met = np.zeros((len(q), n), bool)
        active = np.flatnonzero(self.bounds(q, 0) >= kth)
        kth = kth.copy()
        depth = 0
        while len(active):
            reach = min(n, max(DEPTH, 2 * depth))
            # rows that stand before `reach` in a list from the end that the query favours
            if reach == n:
                seen = np.ones((len(active), n), bool)
            else:
                top, bottom = np.zeros((q.shape[1], n), np.float32), np.zeros((q.shape[1], n), np.float32)
                at = np.arange(q.shape[1])
                bottom[at[None, :], self.up[:reach]] = 1
                top[at[None, :], self.up[n - reach :]] = 1
                sign = q[active]
                seen = ((sign > 0).astype(np.float32) @ top + (sign < 0).astype(np.float32) @ bottom) > 0
            seen &= ~met[active]
            met[active] |= seen
            some = np.flatnonzero(seen.any(axis=0))  # only rows that a query has met are scored
            scores = np.where(seen[:, some] & (self.ids[some][None, :] != own[active][:, None]), q[active] @ self.x[some].T, -np.inf)
            slack = self.slack(q[active], self.x[some].T)
            # a row may count if it can reach the k-th best so far and the k-th best of these
            low = np.where(np.isneginf(scores), -np.inf, np.clip(scores - slack, LEAST, MOST))
            high = np.where(np.isneginf(scores), -np.inf, np.clip(scores + slack, LEAST, MOST))
            least = np.partition(low, len(some) - k, axis=1)[:, len(some) - k] if len(some) >= k else np.full(len(active), -np.inf)
            good = (high >= np.maximum(least, kth[active])[:, None]) & ~np.isneginf(scores)
            for row, i in enumerate(active.tolist()):
                at = np.flatnonzero(good[row])
                if len(at):
                    exact = scores[row, at].astype(np.int64).tolist() if not slack[row, at].any() else self.whole(q[i], some[at])
                    # rows stand in order of their ids
                    out[i] = sorted(out[i] + list(zip(exact, some[at].tolist(), strict=True)), key=lambda x: (-x[0], x[1]))[:k]
                    if len(out[i]) == k:
                        kth[i] = max(kth[i], float(out[i][-1][0]) - abs(float(out[i][-1][0])) * 2.0**-52)
            depth = reach
            active = active[self.bounds(q[active], depth) >= kth[active]] if depth < n else active[:0]
        return out


def _numbers(v) -> np.ndarray:
    return np.asarray(v, np.float64)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Pack rows (vec_id, vector) into rows (ids, dims, components)."""
    ids, vecs = [], []

    def ship() -> pa.RecordBatch:
        dims = max((len(v) for v in vecs), default=0)
        x = np.zeros((len(vecs), dims))
        for i, v in enumerate(vecs):
            x[i, : len(v)] = v
        return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([dims], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["ids", "dims", "x"])

    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            vecs.append(v)
            if len(ids) == rows:
                yield ship()
                ids, vecs = [], []
    if ids:
        yield ship()


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack rows (vec_id, v, qb) sorted by qb into one row for each qb."""

    def ship(qb: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        (packed,) = _blocks(iter(held), sum(h.num_rows for h in held))
        return pa.RecordBatch.from_arrays([pa.array([qb], pa.int64()), *packed.columns], ["qb", "q_ids", "q_dims", "q_x"])

    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if held and key[a] != now:
                yield ship(now, held)
                held = []
            now = int(key[a])
            held.append(b.slice(a, z - a))
    if held:
        yield ship(now, held)


def _unpack(ids: bytes, dims: int, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(x, np.float64).reshape(len(i), dims)


def _wide(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}  # of each query met here: (-score, id); at most k
        block_of: dict[bytes, SortedLists] = {}
        for b in batches:
            for ids, dims, x, q_ids, q_dims, q_x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own, q = _unpack(q_ids, q_dims, q_x)
                if ids not in block_of:
                    block_of.clear()
                    block_of[ids] = SortedLists(*_unpack(ids, dims, x))
                block = block_of[ids]
                wide = max(dims, q_dims)
                if wide > block.x.shape[1]:
                    block = SortedLists(block.ids, _wide(block.x, wide))
                kth = np.array([-float(best[i][-1][0]) * (1 - 2.0**-50 * np.sign(-best[i][-1][0])) if len(best.get(i, ())) == k else -np.inf for i in own.tolist()])
                for i, met in zip(own.tolist(), block.search(own, _wide(q, wide), kth, k), strict=True):
                    if met:
                        best[i] = sorted(best.get(i, []) + [(-score, int(block.ids[at])) for score, at in met])[:k]
        q, v, s = [], [], []
        for i, rows in best.items():
            for score, j in rows:
                q.append(i)
                v.append(j)
                s.append(-score)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def whole_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) for the vectors whose components are all finite numbers."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = embeddings.select("vec_id", x.alias("x"), bad.alias("bad")).where("vec_id is not null and x is not null and not bad")
    big = F.lit(2.0**500)

    def floor(c: Column) -> Column:  # the function's result is a long, which holds no larger numbers
        y = F.greatest(-big, F.least(big, c * F.lit(scale)))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return whole.select("vec_id", F.transform("x", floor).alias("v"))


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for (vec_id, v) queries against all (vec_id, v) rows."""
    spark = rows.sparkSession
    packed = "ids binary, dims int, x binary"
    once = queries.groupBy("vec_id").agg(F.max("v").alias("v"))
    once = stage(once, "topk-queries")
    total = once.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n = -(-total // QUERIES)
    keyed = once.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long")).repartition("qb").sortWithinPartitions("qb")
    qn = stage(keyed.mapInArrow(_query_blocks, "qb long, q_ids binary, q_dims int, q_x binary"), "topk-blocks")
    r = rows.mapInArrow(lambda it: _blocks(it, ROWS), packed)
    # every block of rows against every block of queries; Spark broadcasts the query blocks only if they are small
    pairs = r.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(qn, "qb")
    found = pairs.select("ids", "dims", "x", "q_ids", "q_dims", "q_x").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
