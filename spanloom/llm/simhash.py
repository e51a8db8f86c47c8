"""SimHash near-dedup with BK-trees.

Every text gets a 64-bit fingerprint of its word shingles. Fingerprints link when they differ in at most RADIUS = 4
bits. They are searched by BK-trees, whose children are keyed by their integer Hamming distance to the parent; a walk
follows only the edges within the radius. A tree of all fingerprints would grow with the corpus and may not be
broadcast, so trees stand for shards: of b blocks of bits, two linked fingerprints agree on b - 4 at least, and the
fingerprints that agree on one choice of b - 4 blocks are one key's shard. b is 5, 6, 7 or 8, the fewest blocks by which
a key has KEYED fingerprints on average or fewer; every choice finds the same links. A key of more than SHARD
fingerprints has several trees of at most SHARD each. Every tree is walked by the fingerprints of its own shard, and
those of a key with several also by the others of the key: these trees are broadcast where their checked size allows it, and
meet their walkers in a join elsewhere. Links reduce to a spanning forest inside a task, and connected components
follow by large-star/small-star rounds.

`near_groups` is the search by fingerprints alone (four words, four bits). `drop_near` finds the texts whose five-word shingles
have a Jaccard similarity of 0.8 or more: its shards are the texts under one shingle (see ``shingles.py``), their trees are walked within
NEAR_RADIUS bits, and an exact check of the texts follows.

Defined cases: null and empty texts have fingerprint zero and link like any other; ties go to the
smallest id; a null id is never a component's id unless the component has no other; repeated rows and
extra columns are carried as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bktree import BKForest
from .common import listed, own_name, scratch, slices, stage
from .fingerprints import fingerprint
from .graph import components, spanning
from .shingles import near_pairs

RADIUS = 4
#: Fingerprints of one key that share a tree, at most; of a key on average, at most, unless it takes eight blocks or more.
SHARD, KEYED = 512, 64
#: Bytes of the trees of many-tree keys up to which they are broadcast.
BROADCAST_TREES = 32 << 20


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        prints = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["doc_id", "fp"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, fp) sorted by (key, part) to one tree (key, part, prints, link) for each; groups may straddle batches."""
    held: list[np.ndarray] = []

    def grown(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, part, fp = cols
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(key) != 0) | (np.diff(part) != 0)
        starts = np.flatnonzero(new)
        sizes = np.diff([*starts, len(key)])
        alone = (sizes == 1) & (part[starts] < 0)  # keys of one fingerprint have nothing to find
        pick = ~np.repeat(alone, sizes)
        starts, tree = starts[~alone], np.repeat(np.arange(int((~alone).sum())), sizes[~alone])
        forest, place = BKForest.of(fp[pick].view(np.uint64), tree)
        # back from levels to trees, each with its own numbers
        of = tree[place]
        order = np.argsort(of, kind="stable")
        count = sizes[~alone]
        first = np.cumsum(count) - count
        number = np.empty(len(of), np.int64)
        number[order] = np.arange(len(of)) - first[of[order]]
        link = forest.link
        link = np.where(link < 0, -1, number[link // 128] * 128 + link % 128)[order]
        prints, cuts = forest.prints[order], [*first.tolist(), len(of)]
        blobs = [[x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for x in (prints, link)]
        return pa.RecordBatch.from_arrays([pa.array(key[starts]), pa.array(part[starts]), *(pa.array(x, pa.binary()) for x in blobs)], ["key", "part", "prints", "link"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [x.to_numpy(zero_copy_only=False) for x in b.columns]
        cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)] if held else cols
        change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield grown([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held and len(held[0]):
        yield grown(held)


def _walked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (prints, link, walkers): the walkers go down the tree."""
        for b in batches:
            if not b.num_rows:
                continue
            trees = [(np.frombuffer(p, np.uint64), np.frombuffer(x, np.int64)) for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            walkers = [np.frombuffer(w, np.uint64) for w in b.column(2).to_pylist()]
            forest, number = BKForest.joined(trees)
            sizes = np.array([len(p) for p, _ in trees], np.int64)
            root = np.repeat(number[np.cumsum(sizes) - sizes], [len(w) for w in walkers])
            queries = np.concatenate(walkers)
            both = np.concatenate([forest.prints, queries])
            values, at = np.unique(both, return_inverse=True)
            node, query = at[: len(forest.prints)], at[len(forest.prints) :]
            left, right = spanning(len(values), ((query[q], node[n]) for q, n in forest.walk(queries, root, radius)))
            yield pa.RecordBatch.from_arrays([pa.array(values[left].view(np.int64)), pa.array(values[right].view(np.int64))], ["u", "v"])

    return run


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks of bits by which a key of n random fingerprints holds KEYED or fewer."""
    return next((b for b in range(radius + 1, radius + 4) if n >> (64 * (b - radius) // b) <= KEYED), radius + 4)


def keys(fp: Column, blocks: int, radius: int = RADIUS) -> Column:
    """One key for each choice of ``blocks - radius`` blocks: a hash of their bits and of the choice."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(bounds, bounds[1:], strict=False)]
    return F.array(*[F.xxhash64(*[parts[i] for i in choice], F.lit(k)) for k, choice in enumerate(combinations(range(blocks), blocks - radius))])


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints within ``radius``, enough to span every component; ``prints`` (fp) is evaluated again: pass a staged table."""
    blocks = blocks_for(prints.count(), radius) if blocks is None else blocks
    keyed = prints.select("fp", F.explode(keys(F.col("fp"), blocks, radius)).alias("key"))
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD)
    many = stage(many.select(F.col("key").alias("many"), F.ceil(F.col("n") / SHARD).alias("parts")), "simhash-many")
    placed = keyed.join(listed(many), F.col("key") == F.col("many"), "left")
    rows = placed.select("key", F.coalesce(F.pmod(F.xxhash64("fp", F.lit(5)), F.col("parts")), F.lit(-1)).cast("int").alias("part"), "fp")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    trees = stage(rows.mapInArrow(_trees, "key long, part int, prints binary, link binary"), "simhash-trees")
    own = trees.select("prints", "link", F.col("prints").alias("walkers"))
    several = trees.where("part >= 0")
    size = several.agg(F.sum(F.octet_length("prints") + F.octet_length("link"))).first()[0] or 0
    out = own
    if size:
        shard_trees = several.select("key", "part", "prints", "link")
        shard_trees = F.broadcast(shard_trees) if size <= BROADCAST_TREES else shard_trees
        others = several.select("key", F.col("part").alias("other"), F.col("prints").alias("walkers"))
        # every pair of a key's trees meets once
        out = own.unionByName(others.join(shard_trees, "key").where("part < other").select("prints", "link", "walkers"))
    return out.mapInArrow(_walked(radius), "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    printed = stage(source.mapInArrow(_prints, f"doc_id {id_type}, fp long"), "simhash-prints")
    distinct = stage(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(near_links(distinct.select("fp"), radius))
    linked = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    named = linked.join(distinct, "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.join(ids, "root").select("fp", "component_id")
    all_ = distinct.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # written first: Spark can then split a hot fingerprint's rows in the join, or broadcast a small table
    return printed.join(stage(all_, "simhash-groups"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of every group of texts linked at a similarity of 0.8 or more on five-word shingles, with all its columns: the one with the smallest id, then hash of the text."""
    row = own_name("_row", docs)
    held = stage(docs.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    with scratch(docs.sparkSession):
        found = components(near_pairs(held.select(F.col(row).alias("_row"), "text")).select(F.col("a").alias("u"), F.col("b").alias("v")))
        found = found.where("node <> root").unionByName(found.select(F.col("root").alias("node"), "root").distinct())
        place = held.select(F.col(row).alias("node"), F.struct(F.col(id_col).alias("id"), F.xxhash64("text").alias("code"), F.col(row).alias("row")).alias("place"))
        # of every group, all rows but the first one
        placed = found.join(place, "node")
        first = placed.groupBy("root").agg(F.min("place").alias("first")).select(F.col("first.row").alias("stays"))
        gone = found.join(first, F.col("node") == F.col("stays"), "left_anti").select(F.col("node").alias(row))
        gone = stage(gone, "near-dropped", lasting=True)
    return held.join(listed(gone), row, "left_anti").select(*docs.columns)
