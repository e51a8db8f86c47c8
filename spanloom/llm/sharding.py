"""Sharding by a k-d tree over document metadata, law `bytes`.

The tree splits at the weighted median (weight: bytes) along the widest metadata dimension until a
leaf holds the target bytes. Dimensions are source, language and length. Equal texts form a group
with the metadata of its smallest row, so copies meet in one leaf; only a group that outweighs
GROUP_SHARE of a shard is cut, into neighbouring pieces. Medians are found from histograms: one
aggregation a level counts BINS bins for every node and dimension, REFINE more narrow the median bin.
What reaches the driver is nodes x dimensions x bins, whatever the corpus.

Defined cases: a null text has size 1 and is the empty text's neighbour, not its equal; null source or
language comes first; repeated rows are equal texts; an empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ordinals, ranked, stage

BINS = 4096
REFINE = 5
#: Narrowing ends when the median bins hold less than this share of their nodes.
ENOUGH = 0.001
#: A group of equal texts heavier than this share of a shard is cut into pieces of about that weight.
GROUP_SHARE = 0.01
#: Width of a dimension in the integer coordinates; below it, the group's hash breaks ties.
TIES = 1 << 34
UNITS = (1 << 20) - 1


def kd_splits(atoms: DataFrame, dims: Sequence[str], shards: int) -> DataFrame:
    """``atoms`` (dims as long coordinates, weight) with the leaf of each as ``shard``."""
    cuts: dict[int, tuple[str, int]] = {}  # by node of the binary heap (root 1): its dimension and upper bound of the left side

    def placed(leaf: Callable[[int], Column], depth: int, node: int = 1) -> Column:
        """An expression over the tree so far; each node stands in it once."""
        if depth == 0:
            return leaf(node)
        dim, cut = cuts[node]
        return F.when(F.col(dim) <= F.lit(cut), placed(leaf, depth - 1, 2 * node)).otherwise(placed(leaf, depth - 1, 2 * node + 1))

    depth = shards.bit_length() - 1
    if shards != 1 << depth:
        raise ValueError("the number of shards is a power of two")
    for level in range(depth):
        nodes = range(1 << level, 2 << level)
        here = placed(lambda n: F.lit(n), level)
        seen = atoms.groupBy(here.alias("node")).agg(F.sum("weight").alias("w"), *[f(d).alias(f"{k}{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]).collect()
        half, range_, chosen = dict.fromkeys(nodes, 0.0), dict.fromkeys(nodes, (0, 0)), dict.fromkeys(nodes, dims[0])
        for r in seen:
            half[r.node] = float(r.w) / 2
            chosen[r.node] = max(dims, key=lambda d, r=r: r[f"hi{d}"] // TIES - r[f"lo{d}"] // TIES)
            range_[r.node] = (r[f"lo{chosen[r.node]}"], r[f"hi{chosen[r.node]}"])
        below, inside = dict.fromkeys(nodes, 0.0), {n: 2 * half[n] for n in nodes}
        for _ in range(REFINE):
            step = {n: max(1, -(-(range_[n][1] - range_[n][0] + 1) // BINS)) for n in nodes}
            value = placed(lambda n: F.col(chosen[n]), level)
            low, width = placed(lambda n: F.lit(range_[n][0]).cast("long"), level), placed(lambda n: F.lit(step[n]).cast("long"), level)
            binned = atoms.select(here.alias("node"), F.floor((value - low) / width).cast("long").alias("bin"), "weight").where((F.col("bin") >= 0) & (F.col("bin") < BINS))
            found: dict = defaultdict(dict)
            for r in binned.groupBy("node", "bin").agg(F.sum("weight").alias("w")).collect():
                found[r.node][r.bin] = float(r.w)
            for n, bins in found.items():
                for k in sorted(bins):
                    inside[n] = bins[k]
                    start = range_[n][0] + k * step[n]
                    if below[n] + bins[k] >= half[n]:
                        break
                    below[n] += bins[k]
                range_[n] = (start, start + step[n] - 1)
            if all(inside[n] <= ENOUGH * half[n] or step[n] == 1 for n in nodes):
                break
        for n in nodes:
            # the last bin goes to the side that it leaves more even
            with_it = abs(below[n] + inside[n] - half[n]) <= abs(half[n] - below[n])
            cuts[n] = (chosen[n], range_[n][1] if with_it else range_[n][0] - 1)
    return atoms.withColumn("shard", placed(lambda n: F.lit(n - shards), depth).cast("int"))


def _numbered(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the values of a column replaced by their places in order; null is -1."""
    places = stage(ordinals(rows, column).withColumnRenamed("value", "_value"), "shard-ordinals")
    joined = rows.join(places, F.col(column) == F.col("_value"), "left").drop(column, "_value")
    return joined.withColumn(column, F.coalesce(F.col("ordinal"), F.lit(-1)).cast("double")).drop("ordinal")


def shard(docs: DataFrame, shards: int = 16, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    raw = F.encode(F.col("text"), "UTF-8")
    crc = F.crc32(F.coalesce(raw, F.lit(b"")))
    rows = docs.select(
        *keep, (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), crc.alias("text_crc32"),
        F.xxhash64("text", F.col("text").isNull()).alias("_g"), F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang"),
    )
    rows = stage(rows, "shard-rows")
    group = ["_g", "text_crc32", "size"]
    rows = _numbered(_numbered(rows, "_source"), "_lang")
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("_source").alias("_source"), F.min("_lang").alias("_lang"))
    groups = groups.withColumn("_len", F.log2(F.col("size").cast("double")))
    groups = stage(groups, "shard-groups")
    dims = ["_source", "_lang", "_len"]
    ends = groups.agg(F.sum(F.col("n") * F.col("size")).alias("w"), *[F.min(d).alias(f"lo{d}") for d in dims], *[F.max(d).alias(f"hi{d}") for d in dims]).first()
    piece = max(1.0, float(ends.w or 0) / shards * GROUP_SHARE)
    pieces = F.least(F.lit(4096), F.ceil(F.col("n") * F.col("size") / F.lit(piece))).cast("int")
    cut = groups.withColumn("pieces", pieces)
    tie = F.shiftrightunsigned(F.xxhash64("_g"), 42) * 4096  # 22 bits of the group, 12 of the piece
    coords = []
    for d in dims:
        lo, hi = float(ends[f"lo{d}"] or 0), float(ends[f"hi{d}"] or 0)
        unit = F.floor((F.col(d) - lo) / F.lit(max(hi - lo, 1e-9)) * UNITS).cast("long")
        coords.append((F.greatest(F.lit(0), F.least(F.lit(UNITS), unit)) * F.lit(TIES) + F.col("tie") + F.col("piece")).alias(f"c{d}"))
    # rows of a piece are dealt by the id's hash, so a piece weighs its share
    atoms = cut.withColumn("tie", tie.cast("long")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    atoms = atoms.select(*group, "pieces", "piece", (F.col("n") * F.col("size") / F.col("pieces")).alias("weight"), *coords)
    leaves = kd_splits(stage(atoms, "shard-atoms"), [f"c{d}" for d in dims], shards).select(*group, "pieces", "piece", "shard")
    whole = leaves.where("pieces = 1").select(*group, "shard")
    # of a group cut in pieces, the leaves by piece; 4096 at most
    split = leaves.where("pieces > 1").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("piece", "shard"))).alias("_leaves"))
    at = whole.select(*group, "shard", F.lit(None).cast("array<struct<piece:int,shard:int>>").alias("_leaves")).unionByName(split.select(*group, F.lit(None).cast("int").alias("shard"), "_leaves"))
    mine = F.pmod(F.xxhash64(*keep, F.lit(3)), F.size("_leaves")).cast("int")
    out = rows.join(at, group).withColumn("shard", F.coalesce("shard", F.get("_leaves", mine)["shard"])).drop("_leaves", "_g", "_source", "_lang")
    out = ranked(stage(out, "shard-placed"), ["shard"], [*keep, "text_crc32", "size"], "slot")
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
