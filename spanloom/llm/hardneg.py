"""Hard negatives by bit-sliced integer products.

Components are whole numbers in two's complement. A block of rows is cut into bit planes, one bit of every component each. A
query takes the planes from the sign down: after the planes above bit L are added to its products, every row's score lies
between the product so far plus (2**L - 1) times the sum of the query's negative components and the same with its positive ones. A row
stays while that interval meets one of the query's bands of scores and can still beat the k-th best lower end
among the rows that are surely in the band; at bit 0 the intervals are the scores. The first planes, which drop
nothing yet, are one matrix product for a block of queries; later ones are read only for the rows a query has left.

The positives of an anchor are the search with one open band among rows of its label; its negatives the search with one band
for each positive among the rows of other labels. Rows and anchors are packed into blocks; blocks of anchors are
copied to SLICES of blocks of rows, so that neither one anchor, one label nor one group of copies is one task's work. A task
returns k rows a band at most.

Products that may pass 2**53 are widened by a bound on their error, and what is left of them is scored in Python's whole numbers. A
score beyond a long stands as the end of the long's range.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; a component whose 256-fold
passes 2**500 stands as 2**500; a shorter vector counts as padded with zeros; rows with the anchor's id are its own rows; a repeated
anchor id is searched once, with its largest label and vector; repeated rows are rows of their own, also as positives;
a negative positive score leaves no band where ``low`` is under ``high``; empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage
from .topk import EXACT, LEAST, MOST, whole_vectors

ROWS, QUERIES = 4096, 512
#: Blocks of rows that one copy of the anchors serves.
SLICE = 8
#: A plane is read for all rows of a block while a query has more than this share of them left.
DENSE = 0.5

BLOCK = "ids binary, labels binary, dims long, x binary"
QUERY = f"qb long, {BLOCK}, bands binary"
FOUND = "anchor_id long, band int, vec_id long, score long"
_FOUND = pa.schema([("anchor_id", pa.int64()), ("band", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Planes:
    """Bit planes of a block of whole numbers, from the sign plane down."""

    def __init__(self, x: np.ndarray):
        self.x = x
        top = float(np.abs(x).max(initial=0))
        #: every component lies in [-2**bits, 2**bits)
        self.bits = int(np.frexp(top)[1]) if top else 0
        self.above = np.floor(x * 2.0**-self.bits)  # -1 or 0: the sign plane

    def signs(self) -> np.ndarray:
        return self.above * 2.0**self.bits

    def plane(self, level: int) -> np.ndarray:
        """Bit ``level`` of every component, as 0.0 or 1.0."""
        y = np.floor(self.x * 2.0**-level)
        return y - 2.0 * np.floor(y * 0.5)


class Block:
    """Rows of one block, searched by blocks of queries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.planes = ids[order], labels[order], Planes(np.ascontiguousarray(x[order]))

    def whole(self, q: np.ndarray, rows: np.ndarray) -> list[int]:
        mine = [int(c) for c in q]
        return [min(MOST, max(LEAST, sum(a * int(b) for a, b in zip(mine, self.planes.x[r], strict=True)))) for r in rows.tolist()]

    def search(self, own: np.ndarray, label: np.ndarray, q: np.ndarray, bands: np.ndarray, kth: np.ndarray, k: int, same: bool) -> list[tuple[int, int, int, int]]:
        """(query, band, score, row's place): rows that may be among a band's k best. ``bands``: queries x m x 2 ends, both in the band; ``kth``: a band's k-th best so far, -inf if fewer."""
        x = self.planes.x
        size = np.abs(q) @ np.abs(x).T
        slack = np.where(size < EXACT, 0.0, size * (q.shape[1] + 4) * 2.0**-51)
        less, more = np.minimum(q, 0).sum(axis=1), np.maximum(q, 0).sum(axis=1)
        mine = (self.labels[None, :] == label[:, None]) == same
        mine &= self.ids[None, :] != own[:, None]
        left = [np.flatnonzero(m) for m in mine]
        # the ends are rounded outwards where they are no doubles
        ends = bands.astype(np.float64)
        low_ends, high_ends = (ends[:, :, i] + np.where(np.abs(ends[:, :, i]) < EXACT, 0.0, s * np.abs(ends[:, :, i]) * 2.0**-52) for i, s in ((0, -1), (1, 1)))
        product = q @ self.planes.signs().T
        sums: list[np.ndarray] | None = None  # of the rows left of each query, once planes are read by rows
        level = self.planes.bits
        while True:
            wide = 2.0**level - 1
            for i, rows in enumerate(left):
                if not len(rows):
                    continue
                so_far = product[i, rows] if sums is None else sums[i]
                low = np.clip(so_far + wide * less[i] - slack[i, rows], LEAST, MOST)
                high = np.clip(so_far + wide * more[i] + slack[i, rows], LEAST, MOST)
                keep = np.zeros(len(rows), bool)
                for m in range(ends.shape[1]):
                    sure = low[(low >= low_ends[i, m]) & (high <= high_ends[i, m])]
                    least = max(kth[i, m], np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -np.inf)
                    keep |= (high >= max(low_ends[i, m], least)) & (low <= high_ends[i, m])
                if not keep.all():
                    left[i] = rows[keep]
                    if sums is not None:
                        sums[i] = so_far[keep]
            if not level or not any(map(len, left)):
                break
            level -= 1
            bit = self.planes.plane(level)
            if sums is None and sum(map(len, left)) > DENSE * product.size:
                product += 2.0**level * (q @ bit.T)
                continue
            if sums is None:
                sums = [product[i, rows] for i, rows in enumerate(left)]
            for i, rows in enumerate(left):
                if len(rows):
                    sums[i] = sums[i] + 2.0**level * (bit[rows] @ q[i])
        out = []
        for i, rows in enumerate(left):
            if not len(rows):
                continue
            exact = self.whole(q[i], rows) if slack[i, rows].any() else (product[i, rows] if sums is None else sums[i]).astype(np.int64).tolist()
            for m, (low, high) in enumerate(bands[i].tolist()):
                met = sorted(((-s, r) for s, r in zip(exact, rows.tolist(), strict=True) if low <= s <= high))[:k]
                out += [(i, m, -s, r) for s, r in met]
        return out


def _packed(ids: list[int], labels: list[int], vecs: list[np.ndarray]) -> list:
    dims = max((len(v) for v in vecs), default=0)
    x = np.zeros((len(vecs), dims))
    for i, v in enumerate(vecs):
        x[i, : len(v)] = v
    return [np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), dims, x.tobytes()]


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds, names = [pa.binary(), pa.binary(), pa.int64(), pa.binary()], ["ids", "labels", "dims", "x"]
    held: tuple[list, list, list] = ([], [], [])

    def ship() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_packed(*held), kinds, strict=True)], names)
        for h in held:
            h.clear()
        return out

    for b in batches:
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            for h, v in zip(held, (row[0], row[1], row[2].values.to_numpy(zero_copy_only=False)), strict=True):
                h.append(v)
            if len(held[0]) == ROWS:
                yield ship()
    if held[0]:
        yield ship()


def _pack_queries(key: tuple, table: pa.Table) -> pa.Table:
    """One row of the anchors of a block; anchors with fewer bands get empty ones."""
    rows = table.sort_by("vec_id").to_pylist()
    most = max(len(r["bands"]) for r in rows)
    bands = np.array([[[b["low"], b["high"]] for b in r["bands"]] + [[MOST, LEAST]] * (most - len(r["bands"])) for r in rows], np.int64)
    packed = _packed([r["vec_id"] for r in rows], [r["label"] for r in rows], [np.asarray(r["v"], np.float64) for r in rows])
    return pa.Table.from_pydict(dict(zip(("qb", "ids", "labels", "dims", "x", "bands"), ([v] for v in (key[0].as_py(), *packed, bands.tobytes())), strict=True)))


def _unpacked(ids: bytes, labels: bytes, dims: int, x: bytes, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, y = np.frombuffer(ids, np.int64), np.frombuffer(x, np.float64)
    y = y.reshape(len(i), dims)
    return i, np.frombuffer(labels, np.int64), y if dims == wide else np.pad(y, ((0, 0), (0, wide - dims)))


def _search(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}  # of a band of an anchor met here: (-score, id); k at most
        made: tuple[bytes, int, Block] | None = None
        for b in batches:
            for row in b.to_pylist():
                wide = max(row["dims"], row["q_dims"])
                if made is None or made[0] != row["ids"] or made[1] != wide:
                    made = (row["ids"], wide, Block(*_unpacked(row["ids"], row["labels"], row["dims"], row["x"], wide)))
                own, label, q = _unpacked(row["q_ids"], row["q_labels"], row["q_dims"], row["q_x"], wide)
                bands = np.frombuffer(row["bands"], np.int64).reshape(len(own), -1, 2)
                full = [[best.get((i, m), ()) for m in range(bands.shape[1])] for i in own.tolist()]
                kth = np.array([[float(-h[-1][0]) - abs(float(h[-1][0])) * 2.0**-52 if len(h) == k else -np.inf for h in hs] for hs in full])
                found: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for i, m, score, at in made[2].search(own, label, q, bands, kth, k, same):
                    found.setdefault((int(own[i]), m), []).append((-score, int(made[2].ids[at])))
                for at, rows in found.items():
                    best[at] = sorted(best.get(at, []) + rows)[:k]
        columns = zip(*((i, m, j, -s) for (i, m), rows in best.items() for s, j in rows), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(columns) or [[]] * 4, _FOUND.types, strict=True)], schema=_FOUND)

    return run


def banded(anchors: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, band, rank, vec_id, score): the k best rows of each band of the (vec_id, label, v, bands) anchors among the staged ``blocks``."""
    spark = blocks.sparkSession
    total = anchors.count()
    if not total:
        return spark.createDataFrame([], f"{FOUND}, rank int")
    n, copies = -(-total // QUERIES), max(1, blocks.count() // SLICE)
    keyed = anchors.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long"))
    queries = stage(keyed.groupBy("qb").applyInArrow(_pack_queries, QUERY), "hardneg-anchors")
    longs = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    theirs = queries.select("qb", "bands", *[F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "dims", "x")], longs(copies).alias("slice"))
    mine = blocks.withColumn("slice", F.pmod("block", F.lit(copies))).drop("block").withColumn("qb", longs(n))
    found = mine.join(theirs, ["qb", "slice"]).drop("qb", "slice").mapInArrow(_search(k, same), FOUND)
    rank = F.row_number().over(W.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def labelled(embeddings: DataFrame, scale: float = 256.0, noisy: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v) of whole vectors with labels; rows whose id is divisible by ``noisy`` stand under the next label."""
    tagged = embeddings.where("vec_id is not null and label is not null").select(F.struct("vec_id", F.col("label").cast("long").alias("label")).alias("vec_id"), "embedding")
    rows = whole_vectors(tagged, scale).select("vec_id.vec_id", "vec_id.label", "v")
    return rows.withColumn("label", F.when(F.col("vec_id") % noisy == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def mine(anchors: DataFrame, rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Negatives of each anchor and positive: rows of other labels that score between ``low`` and ``high`` hundredths of the positive.

    ``anchors`` and ``rows`` hold (vec_id, label, v). Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    blocks = rows.select("vec_id", "label", "v").mapInArrow(_pack_rows, BLOCK).withColumn("block", F.monotonically_increasing_id())
    blocks = stage(blocks, "hardneg-rows")
    once = stage(anchors.groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v"), "hardneg-anchors")
    everything = F.array(F.struct(F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    positive = stage(banded(once.withColumn("bands", everything), blocks, positives, True), "hardneg-positives")
    # 100 s lies between low p and high p just where s does between these whole numbers
    share = lambda of: F.col("score").cast("decimal(20,0)") * of / 100
    ends = F.struct(F.ceil(share(low)).cast("long").alias("low"), F.floor(share(high)).cast("long").alias("high"))
    bands = positive.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", ends.alias("ends")))).alias("b"))
    bands = bands.select(F.col("anchor_id").alias("vec_id"), F.col("b.ends").alias("bands"))
    negative = banded(once.join(bands, "vec_id"), blocks, negatives, False)
    its = positive.select("anchor_id", (F.col("rank") - 1).alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negative.join(its, ["anchor_id", "band"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
