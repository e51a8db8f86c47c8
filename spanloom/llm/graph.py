"""Connected components of links by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import stage


#: Links for which a task is kept, about; there are as many tasks as the cluster runs at once, at least.
EDGES = 1 << 20


def _state(edges: DataFrame) -> Row:
    """Number and hashes of the edges."""
    return edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); root is the smallest node that it reaches.

    A round has seven shuffles, and every search several rounds: their partitions are put together to tasks by the number of edges,
    as the driver holds what each task reports, however little it did.
    """
    edges = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    spark, state = links.sparkSession, _state(edges)
    while state.n:
        tasks = max(spark.sparkContext.defaultParallelism, -(-state.n // EDGES))
        few = tasks < int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = lambda df: df.coalesce(tasks) if few else df  # noqa: B023, E731
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = dealt(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = dealt(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        large = dealt(large.distinct())
        down = dealt(large.groupBy("u").agg(F.min("v").alias("m")))
        small = dealt(large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        edges = stage(dealt(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct()), "links")
        new = _state(edges)
        if state == new:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs over n positions that make a spanning forest of them; ``root``: the first position of what is one already."""
    root, left, right = np.arange(n) if root is None else root.copy(), [], []
    for q, t in pairs:
        ra, rb = root[q], root[t]
        apart = np.flatnonzero(ra != rb)
        if not len(apart):
            continue
        lo, hi = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
        _, first = np.unique(hi * n + lo, return_index=True)
        for k in first.tolist():
            x, y = int(lo[k]), int(hi[k])
            while root[x] != x:
                x = int(root[x])
            while root[y] != y:
                y = int(root[y])
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(int(q[apart[k]]))
                right.append(int(t[apart[k]]))
        while (root[root] != root).any():
            root = root[root]
    return np.array(left, np.int64), np.array(right, np.int64)
