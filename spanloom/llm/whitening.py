"""Whitening of vectors by hierarchical merging of singular value decompositions.

Every task decomposes its vectors block by block and keeps, of what it has read, the number of vectors, their exact sums and all
singular values with their right vectors. Two such states merge without loss: their values times their vectors are stacked, a row
sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2) for the distance of the means is appended, and the stack is decomposed again; no dimension
is dropped. The states of the tasks merge in a tree of FAN_IN, each level a staged table, so a task holds FAN_IN states of at most
dims x dims numbers whatever the number of vectors. Only the last state and sums of 32 x 32 numbers reach the driver.

Entries are scaled to whole numbers first, so sums, means and deviations are exact, and vectors are centred before they are
multiplied: a large common offset costs no digits.

Defined cases: a vector that is null or holds a null or non-finite entry takes no part; a null id stays; a shorter vector counts as
padded with zeros; an entry beyond 2**62 after scaling stands as 2**62; a component without variance has a null for its coordinate
and takes no part in the identity's error; a deviation beyond a long stands as the largest long; repeated vectors count as often
as they stand; empty tables and tables of empty vectors give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Entries c stand as floor(SCALE c) + OFFSET.
SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 32
#: States that one task merges; bytes of a block of vectors in doubles.
FAN_IN, BLOCK = 8, 16 << 20
FAR, MOST = 1 << 62, (1 << 63) - 1

STATE = "part long, n long, sums array<string>, rows int, data binary"
_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("rows", pa.int32()), ("data", pa.binary())])


@dataclass
class Spread:
    """n vectors with their exact sums; ``axes`` are the singular values of the centred vectors times their right vectors."""

    n: int
    sums: list[int]
    axes: np.ndarray

    def merged(self, other: Spread) -> Spread:
        n = self.n + other.n
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        stacked = np.vstack([self.axes, other.axes, np.sqrt(self.n * other.n / n) * apart])
        return Spread(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], axes_of(stacked))


@dataclass
class Scatter:
    """Means and centred products of n rows; the means are sums over n here, so that both merge as Spread does."""

    n: int
    sums: list[float]
    axes: np.ndarray

    def merged(self, other: Scatter) -> Scatter:
        n = self.n + other.n
        apart = np.array(self.sums) / self.n - np.array(other.sums) / other.n
        return Scatter(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.axes + other.axes + np.outer(apart, apart) * (self.n * other.n / n))


@dataclass
class Model:
    n: int
    sums: list[int]
    #: eigenvalues of the covariance, falling, and their unit vectors as rows, for all dimensions
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        total = float(self.values.sum())
        return [float(e) / total if total else 0.0 for e in self.values]

    def live(self, components: int) -> np.ndarray:
        """Of the first components, which have variance beyond rounding."""
        s = np.sqrt(self.values[:components])
        return s > (s[0] if len(s) else 0.0) * max(len(self.values), 64) * 2.0**-52


def axes_of(x: np.ndarray) -> np.ndarray:
    """Singular values times right vectors of x: as many rows as x has rows or columns, whichever is less."""
    _, s, v = np.linalg.svd(x, full_matrices=False)
    return s[:, None] * v


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums in whole numbers: as longs where they fit, else as Python's."""
    top = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if top < FAR:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def scaled(column: pa.ListArray, dims: int, scale: float = SCALE, offset: int = OFFSET) -> np.ndarray:
    """The whole numbers of a column of vectors."""
    out = np.zeros((len(column), dims))
    length = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(dims)[None, :] < length[:, None]] = flat
    with np.errstate(over="ignore"):
        whole = np.floor(out * scale)
    return np.clip(whole, -float(FAR), float(FAR)).astype(np.int64) + offset


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BLOCK // (8 * dims))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _shipped(state: Spread | Scatter, part: int) -> pa.RecordBatch:
    axes = np.ascontiguousarray(state.axes)
    return pa.RecordBatch.from_pylist([{"part": part, "n": state.n, "sums": [repr(x) for x in state.sums], "rows": len(axes), "data": axes.tobytes()}], schema=_ARROW)


def _read(n: int, sums: list[str], rows: int, data: bytes, kind: type) -> Spread | Scatter:
    return kind(n, [int(x) if kind is Spread else float(x) for x in sums], np.frombuffer(data).reshape(rows, -1))


def gathered(states: DataFrame, kind: type) -> Spread | Scatter | None:
    """Merge the tasks' states in a tree of staged levels; None if there are none."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        held = sorted(table.select(["part", "n", "sums", "rows", "data"]).to_pylist(), key=lambda r: r["part"])
        state = reduce(lambda a, b: a.merged(b), (_read(r["n"], r["sums"], r["rows"], r["data"], kind) for r in held))
        return pa.Table.from_batches([_shipped(state, key[0].as_py())])

    level = stage(states, "whitening-states")
    count = level.count()
    while count > 1:
        groups = -(-count // FAN_IN)
        # part numbers are 0, 1, ... from the second level on; those of tasks have gaps where a task met no vector
        level = stage(level.groupBy(F.pmod("part", F.lit(groups)).alias("g")).applyInArrow(merge, STATE), "whitening-states")
        count = level.count()
    return next((_read(r.n, r.sums, r.rows, r.data, kind) for r in level.collect()), None)


def _task_states(blocks: Iterator[Spread | Scatter]) -> Iterator[pa.RecordBatch]:
    state = None
    for block in blocks:
        state = block if state is None else state.merged(block)
    if state is not None:
        yield _shipped(state, TaskContext.get().partitionId())


def whole(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors whose entries are all finite numbers."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return embeddings.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & ~bad)


def fit(vectors: DataFrame, scale: float = SCALE, offset: int = OFFSET) -> Model | None:
    """Principal axes of all (vec_id, embedding) vectors; None where there is no dimension."""
    dims = vectors.agg(F.max(F.size("embedding")).alias("d")).head().d
    if not dims:
        return None

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(b: pa.RecordBatch) -> Spread:
            x = scaled(b.column(0), dims, scale, offset)
            sums = x.sum(axis=0).tolist() if int(np.abs(x).max(initial=0)) * len(x) < FAR else [sum(c) for c in x.T.tolist()]
            return Spread(len(x), sums, axes_of(centred(x, len(x), sums).astype(np.float64) / len(x)))

        return _task_states(of(b) for b in _blocks(batches, dims))

    state = gathered(vectors.select("embedding").mapInArrow(spread, STATE), Spread)
    _, s, v = np.linalg.svd(state.axes, full_matrices=True)
    largest = v[np.arange(dims), np.abs(v).argmax(axis=1)]
    values = np.zeros(dims)
    values[: len(s)] = s * s / state.n
    return Model(state.n, state.sums, values, v * np.where(largest < 0, -1.0, 1.0)[:, None])


def _projected(model: Model, components: int, scale: float, offset: int) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    dims, live = len(model.values), model.live(components)
    basis = (model.vectors[:components][live] / np.sqrt(model.values[:components][live])[:, None]).T

    def run(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The whole numbers n x - sums, and coordinates on the components that have variance."""
        off = centred(scaled(column, dims, scale, offset), model.n, model.sums)
        return off, (off / model.n).astype(np.float64) @ basis

    return run


def whiten(vectors: DataFrame, model: Model, components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, deviation, whitened): coordinates on the first components, over the root of their variance."""
    components = min(components, len(model.values))
    run, live, dims = _projected(model, components, scale, offset), model.live(components), len(model.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, dims):
            off, inner = run(b.column(1))
            if off.dtype == object or dims * int(np.abs(off).max(initial=0)) ** 2 > MOST:
                deviation = [min(MOST, sum(t * t for t in r)) for r in off.tolist()]
            else:
                deviation = (off * off).sum(axis=1)
            out = np.full((len(off), components), np.nan)
            out[:, live] = inner
            flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(off) + 1) * components, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(rows, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(vectors: DataFrame, model: Model, components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET) -> float:
    """Largest absolute entry of the covariance of all whitened vectors minus the identity."""
    components = min(components, len(model.values))
    run, dims, live = _projected(model, components, scale, offset), len(model.values), int(model.live(components).sum())
    if not live:
        return 0.0

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(b: pa.RecordBatch) -> Scatter:
            _, w = run(b.column(0))
            inner = w - w.mean(axis=0)
            return Scatter(len(w), w.sum(axis=0).tolist(), inner.T @ inner)

        return _task_states(of(b) for b in _blocks(batches, dims))

    total = gathered(vectors.select("embedding").mapInArrow(scatter, STATE), Scatter)
    return float(np.abs(total.axes / total.n - np.eye(live)).max())
