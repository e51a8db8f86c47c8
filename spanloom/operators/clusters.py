"""Voices of one recording grouped by average linkage under cosine distance.

The mean distance of two groups of unit vectors is one less the product of their mean vectors, so a group is its sum and its size: linkage
needs no matrix of distances. A key's vectors meet in one task, which holds them once and takes time with the square of their
number; keys are recordings, whose voiced segments are thousands at most.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def directions(x: np.ndarray, variance: float | None = 0.95) -> np.ndarray:
    """Rows standardised by column, turned to the fewest principal axes that hold ``variance`` of it (if there are more than three columns and two rows), and scaled to length 1."""
    dev = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(dev > 0, dev, 1.0)
    if variance is not None and x.shape[1] > 3 and len(x) > 2:
        values, axes = np.linalg.eigh(x.T @ x)
        values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        x = x @ axes[:, : int(np.searchsorted(share, variance, side="right")) + 1]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(size > 1e-8, x / np.maximum(size, 1e-300), 0.0)


def linkage(x: np.ndarray) -> list[tuple[float, int, int]]:
    """All merges of unit rows by average cosine distance as (distance, row, row), nearest first, by chains of nearest neighbours."""
    sums, size, open_ = x.copy(), np.ones(len(x)), np.ones(len(x), bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    for _ in range(len(x) - 1):
        if not chain:
            chain = [int(np.argmax(open_))]
        while True:
            a = chain[-1]
            away = np.where(open_, 1 - sums @ sums[a] / (size * size[a]), np.inf)
            away[a] = np.inf
            b = int(np.argmin(away))
            if len(chain) > 1 and away[chain[-2]] <= away[b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        merges.append((float(away[b]), a, b))
        sums[a] += sums[b]
        size[a] += size[b]
        open_[b] = False
    return sorted(merges)


def cut(n: int, merges: list[tuple[float, int, int]], groups: int | None, below: float | None) -> np.ndarray:
    """Numbers from 0, by first row, of the groups that the merges leave: ``groups`` of them, or those of all merges nearer than ``below``."""
    up = np.arange(n)
    use = merges[: n - groups] if groups is not None else [m for m in merges if m[0] < below]

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    for _, a, b in use:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return np.unique([top(i) for i in range(n)], return_inverse=True)[1]


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette of unit rows under cosine distance; 1 for one group, 0 where every row is a group of its own."""
    k = int(label.max()) + 1
    if k < 2 or k >= len(x):
        return 1.0 if k == 1 else 0.0
    sums, size = np.zeros((k, x.shape[1])), np.bincount(label).astype(float)
    np.add.at(sums, label, x)
    total = size[None, :] - x @ sums.T  # from each row to each group, the row itself at distance 1 - |row|^2
    rows = np.arange(len(x))
    own = (total[rows, label] - (1 - (x * x).sum(axis=1))) / np.maximum(size[label] - 1, 1)
    mean = total / size
    mean[rows, label] = np.inf
    other = mean.min(axis=1)
    s = np.where(size[label] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
    return float(s.mean())


def grouped(vectors: np.ndarray, below: float, expected: int | None, fewest: int, most: int, variance: float | None) -> tuple[np.ndarray, float]:
    """(group of each row, silhouette): ``expected`` groups, else those nearer than ``below``, held between ``fewest`` and ``most``."""
    n = len(vectors)
    x = directions(vectors, variance)
    merges = linkage(x)
    if expected is not None or most <= 1:
        label = cut(n, merges, max(1, min(1 if expected is None else expected, n)), None)
    else:
        label = cut(n, merges, None, below)
    k = int(label.max()) + 1
    if k > most >= 1:
        # too many groups are grouped by their means, each mean counting once
        means = np.vstack([x[label == i].mean(axis=0) for i in range(k)])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-300)
        label = np.unique(cut(k, linkage(means), most, None)[label], return_inverse=True)[1]
    elif k < fewest <= n:
        label = cut(n, merges, fewest, None)
    return label, silhouette(x, label)


def voice_groups(vectors: DataFrame, by: Sequence[str], below: float = 0.7, expected: int | None = None, fewest: int = 1, most: int = 10, variance: float | None = 0.95) -> DataFrame:
    """(by, id, cluster, silhouette) of voices (id, v) by key; rows without a vector, or with a null or non-finite number, are in cluster -1.

    All vectors of a key have one length. Groups are numbered from 0 by their smallest id.
    """
    whole = F.col("v").isNotNull() & ~F.coalesce(F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True))
    kept = vectors.select(*by, "id", F.when(whole & (F.size("v") > 0), F.col("v").cast("array<double>")).alias("v"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        label, score = grouped(np.vstack(pdf["v"].to_numpy()), below, expected, fewest, most, variance)
        return pdf[[*by, "id"]].assign(cluster=label.astype(np.int32), silhouette=score)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*by, "id").schema) + ", cluster int, silhouette double"
    none = kept.where("v is null").select(*by, "id", F.lit(-1).alias("cluster"), F.lit(None).cast("double").alias("silhouette"))
    return kept.where("v is not null").groupBy(*by).applyInPandas(one, schema).unionByName(none)
