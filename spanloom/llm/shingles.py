"""Texts whose five-word shingles have a Jaccard similarity of 0.8 or more, by BK-trees of their fingerprints.

Two texts are near-copies if their sets of distinct five-word shingles share four fifths of their union or more. With
the shingles of all texts in one order, such a pair shares one of the first n - ceil(0.8 n) + 1 shingles of either, so a shard
is the texts under one of these shingles. The SimHash fingerprints of a shard stand in a BK-tree, which each of
its texts walks within RADIUS bits; the texts of a pair so found, if its sizes allow the similarity, are compared as a whole.
Fingerprints are of the distinct shingles, as the similarity is. At a similarity of 0.8 a bit differs with a chance
of 0.15 (0.19 for the shortest texts), so more than 28 of 64 bits differ with a chance of 1 in 10**8 (1 in 10**6). The order puts shingles that are common in a sample last; it
decides how many pairs meet and never which are linked. Shingles are 64-bit hashes.

Texts under a shingle that the sample shows to be frequent are dealt to packs of about PACK, so no task holds such a
group whole. Under a shingle of more than RING texts, each text is first compared with two others only. What that links need not meet
again: of the pairs that the walks find between different components, a spanning forest is checked. Where pairs of it
fail, the components at their ends are spanned again without the failed pairs, and after ROUNDS rounds all pairs that are left
between such components are checked. So the pairs of a group of near-copies grow with its size as long as few of them fail.

Variants of one text share many shingles, under each of which nearly the same texts meet. Such groups are put together before
they are walked (see ``merged``), so a text is dealt once for each set of texts that it meets, not for each shingle.

Defined cases: a text of fewer than five words is one shingle; null and empty texts are alike; of every group of
linked texts the first row stays; repeated rows and extra columns are carried as they are; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import BKForest, distance
from .common import listed, slices, stage
from .fingerprints import hashed, simhash
from .graph import components, spanning

SHINGLE = 5
#: Bits by which the fingerprints of a pair may differ.
RADIUS = 28
#: Rows of the sample by which common shingles are known, about; its rows that make a shingle common; shingles so kept.
SAMPLE, COMMON, MOST = 20_000, 4, 100_000
#: One in so many rows tells which of the shingles that texts would meet under are common all the same; shingles so kept.
SHARE, LISTED = 4, 1_000_000
#: Texts under one shingle that meet in all their pairs at once.
RING = 16
#: Texts of one shingle that meet in one task, at most; that are numbered in one, about.
SHARD, PACK = 1 << 14, 1 << 16
#: Pairs that are held at once.
MEET = 1 << 16
#: Bytes of texts whose shingles are held at once, about.
TEXT_BYTES = 2 << 20
#: Bits of the sketch by which pairs are rejected before their texts are brought together.
WIDE = 1024
#: Rounds after the first by which failed pairs are replaced; the last one tries every pair that is left.
ROUNDS = 3
#: What a row does in its group: stand in the tree, walk it.
TREE, WALK = 1, 2


def shingles(text: str | None) -> np.ndarray:
    """Distinct shingles of one text, sorted; a text without words has the empty one."""
    return _distinct(hashed(text, SHINGLE))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes.view(np.int64)) if len(hashes) else np.zeros(1, np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets share four fifths of their union."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def _may(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n, m can be similar."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", TEXT_BYTES):
        found, n = np.unique(np.concatenate([shingles(t) for t in b.column(1).to_pylist()]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["shingle", "n"])


def _often(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that COMMON rows or more of ``counts`` (shingle, n) have, sorted, and how many each."""
    rows = counts.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(most).toArrow()
    found, n = rows.column(0).to_numpy().astype(np.int64), rows.column(1).to_numpy().astype(np.int64)
    order = np.argsort(found)
    return found[order], n[order]


def common(held: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and how many rows have each, about.

    A sample of SAMPLE rows tells them less and less finely as the table grows. So of a fixed share of all rows, the shingles that texts
    would meet under by that sample are counted, and those that turn out common are added: groups do not grow with the table for want of an order.
    """
    rate = max(1, held.count() // SAMPLE)
    texts = held.select("_row", "text")
    names, n = _often(texts.where(F.pmod(F.xxhash64("_row"), F.lit(rate)) == 0).mapInArrow(_sampled, "shingle long, n long"), MOST)
    n = n * rate
    if rate > SHARE:
        known = held.sparkSession.sparkContext.broadcast((names, n))
        more, m = _often(texts.where(F.pmod(F.xxhash64("_row", F.lit(1)), F.lit(SHARE)) == 0).mapInArrow(_counted(known), "shingle long, n long"), LISTED)
        new = ~np.isin(more, names)
        names, n = np.concatenate([names, more[new]]), np.concatenate([n, m[new] * SHARE])
        order = np.argsort(names)
        names, n = names[order], n[order]
    return names, n


def _first(sets: list[np.ndarray], names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles under which the sets meet, the number of the set of each, and how many rows have it, about (0: few)."""
    n = np.array([len(s) for s in sets], np.int64)
    every, starts = np.concatenate(sets), np.cumsum(n) - n
    often = np.zeros(len(every), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, every), len(names) - 1)
        often = np.where(names[at] == every, counts[at], 0)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((every, often, owner))
    at = order[np.arange(len(every)) - starts[owner] < (n - (4 * n + 4) // 5 + 1)[owner]]
    return every[at], owner[at], often[at]


def _counted(known) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TEXT_BYTES):
            found, n = np.unique(_first([shingles(t) for t in b.column(1).to_pylist()], *known.value)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["shingle", "n"])

    return run


def _prefixes(known) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TEXT_BYTES):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            prints = np.array([simhash(x.view(np.uint64)) for x in sets], np.uint64).view(np.int64)
            n = np.array([len(s) for s in sets], np.int32)
            found, who, often = _first(sets, *known.value)
            packs = (often // PACK + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found, b.column(0).to_numpy()[who], n[who], prints[who], packs)], ["shingle", "row", "n", "fp", "packs"])

    return run


def _grouped(emit: Callable, keys: int) -> Callable:
    """Hand ``emit`` whole groups: columns, starts and ends; rows come sorted by the first ``keys`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []  # rows of the group that is still open

        def flush(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:keys]], axis=0)) + 1
            yield from emit(cols, np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cols[0])]]))

        for b in batches:
            if not b.num_rows:
                continue
            cols = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            same = not parts or all(p[-1] == c[0] for p, c in zip(parts[-1][:keys], cols[:keys], strict=True))
            change = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:keys]], axis=0))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut or not same:
                yield from flush([np.concatenate(x) for x in zip(*parts, [c[:cut] for c in cols], strict=True)])
                parts = []
            parts.append([c[cut:] for c in cols])
        if parts:
            yield from flush([np.concatenate(x) for x in zip(*parts, strict=True)])

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each number."""
    y = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return y ^ (y >> np.uint64(32))


def _shared(cols: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that two texts or more have, with the group's size and, in large groups, one other text to compare first.

    Of a group in several packs this is the pack's size, or more than RING. ``sig`` is one hash of the group's rows: near-copies share many
    shingles, whose groups have the same rows and need to meet once.
    """
    shingle, _, row, n, fp, packs = cols
    size = np.maximum(np.repeat(ends - starts, ends - starts), np.where(packs > 1, RING + 1, 0))
    keep = size > 1
    mixed = _mixed(row)
    sig = np.add.reduceat(mixed, starts) ^ _mixed(np.bitwise_xor.reduceat(mixed, starts).view(np.int64)) ^ np.where(packs[starts] > 1, _mixed(shingle[starts]), np.uint64(0))
    sig = np.repeat(sig, ends - starts).view(np.int64)
    other = np.full(len(row), -1, np.int64)
    for a, b in zip(starts, ends, strict=True):
        if b - a > RING:
            # another order under each shingle, so that a text meets others
            order = a + np.argsort(_mixed(row[a:b] ^ shingle[a]), kind="stable")
            i, j = order[:-1], order[1:]
            ok = _may(n[i].astype(np.int64), n[j].astype(np.int64)) & (distance(fp[i].view(np.uint64), fp[j].view(np.uint64)) <= RADIUS)
            other[i[ok]] = row[j[ok]]
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (shingle, row, n, fp, size.astype(np.int64), other, sig)], ["shingle", "row", "n", "fp", "size", "other", "sig"])


def _meet(every: bool) -> Callable:
    """Pairs (a, b) that the walks of every group find, that sizes and sketches allow, that are not of one component and have not failed: all, or enough to span what they join."""

    def run(cols: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, _, _, row, n, fp, group, role, wide, failed = cols
        n, prints = n.astype(np.int64), fp.view(np.uint64)
        sketch = np.frombuffer(b"".join(wide.tolist()), np.uint64).reshape(len(row), -1)
        which = np.repeat(np.arange(len(starts)), ends - starts)
        # pairs that failed before, as numbers of their places among the rows
        rows, place_of = np.unique(row, return_inverse=True)
        failing = [(np.full(len(f), i), np.asarray(f, np.int64)) for i, f in zip(place_of.tolist(), failed.tolist(), strict=True) if f is not None and len(f)]
        known = np.zeros(0, np.int64)
        if failing:
            own, other = (np.concatenate(x) for x in zip(*failing, strict=True))
            at = np.minimum(np.searchsorted(rows, other), len(rows) - 1)
            own, at = own[rows[at] == other], at[rows[at] == other]
            known = np.unique(np.minimum(own, at) * len(rows) + np.maximum(own, at))

        def nodes(part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Fingerprints by group of the rows that take this part, the group of each, and its rows: order[first:last]."""
            mine = np.flatnonzero(role & part)
            order = mine[np.lexsort((prints[mine], which[mine]))]
            new = np.ones(len(order), bool)
            new[1:] = (which[order][1:] != which[order][:-1]) | (prints[order][1:] != prints[order][:-1])
            first = np.flatnonzero(new)
            return prints[order][first], which[order][first], order, first, np.concatenate([first[1:], [len(order)]])[: len(first)]

        tree, tree_of, t_order, t_first, t_last = nodes(TREE)
        walker, walker_of, q_order, q_first, q_last = nodes(WALK)
        if not len(tree) or not len(walker):
            return
        names, number = np.unique(tree_of, return_inverse=True)
        forest, place = BKForest.of(tree, number)
        at = np.minimum(np.searchsorted(names, walker_of), len(names) - 1)
        go = names[at] == walker_of
        walker, at, q_first, q_last = walker[go], at[go], q_first[go], q_last[go]

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for q, node in forest.walk(walker, forest.roots[at], RADIUS):
                t = place[node]
                wide_ = t_last[t] - t_first[t]
                many = (q_last[q] - q_first[q]) * wide_
                stop = np.cumsum(many)
                for k in range(0, int(stop[-1]), MEET):  # the rows of one fingerprint against those of another may be many
                    k = np.arange(k, min(k + MEET, int(stop[-1])))
                    of = np.searchsorted(stop, k, side="right")
                    k = k - (stop[of] - many[of])
                    i, j = q_order[q_first[q[of]] + k // wide_[of]], t_order[t_first[t[of]] + k % wide_[of]]
                    ok = (group[i] != group[j]) & _may(n[i], n[j])
                    i, j = i[ok], j[ok]
                    # of two sets that are similar, at most a ninth of both sizes differs, and a sketch differs by no more
                    ok = 9 * np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]
                    i, j = i[ok], j[ok]
                    if len(i) and len(known):
                        code = np.minimum(place_of[i], place_of[j]) * len(rows) + np.maximum(place_of[i], place_of[j])
                        new = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] != code
                        i, j = i[new], j[new]
                    if len(i):
                        yield i, j

        if every:
            found = pairs()
        else:
            _, first, of = np.unique(group, return_index=True, return_inverse=True)
            found = [spanning(len(row), pairs(), first[of])]
        for i, j in found:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(row[i], row[j])), pa.array(np.maximum(row[i], row[j]))], ["a", "b"])

    return run


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parity sketch of WIDE bits."""
    for b in slices(batches, "text", TEXT_BYTES):
        out = []
        for t in b.column(1).to_pylist():
            odd = np.bincount(shingles(t).view(np.uint64) >> np.uint64(6) & np.uint64(WIDE - 1), minlength=WIDE) & 1
            out.append(np.packbits(odd.astype(bool)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["row", "wide"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "one", TEXT_BYTES):
        ok = [similar(shingles(x), shingles(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])


def _texts_of(held: DataFrame, ids: DataFrame) -> DataFrame:
    return held.select("_row", "text").join(listed(stage(ids.toDF("_row").distinct(), "near-rows")), "_row", "left_semi")


def verify(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ok) for the pairs (a, b) of rows, by their texts."""
    pairs = stage(pairs.distinct(), "near-pairs")
    texts = _texts_of(held, pairs.select(F.explode(F.array("a", "b"))))
    one, two = texts.toDF("a", "one"), texts.toDF("b", "two")
    return stage(pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(_verified, "a long, b long, ok boolean"), "near-verified")


def merged(shared: DataFrame) -> DataFrame:
    """Groups of ``shared`` (shingle, row, n, fp, size), where many have nearly the same rows as one: every pair of rows of one group is still in one.

    Every row names the largest of its groups, and groups of which more than half the rows name the same one are put together, where
    the rows together have no more pairs than the groups have one by one.
    """
    named = shared.groupBy("row").agg(F.max(F.struct("size", "shingle")).alias("largest")).select("row", F.col("largest.shingle").alias("into"))
    votes = shared.select("shingle", "row").join(named, "row").groupBy("shingle", "into").agg(F.count(F.lit(1)).alias("k"))
    votes = votes.groupBy("shingle").agg(F.max(F.struct("k", "into")).alias("most"), F.sum("k").alias("all")).where(2 * F.col("most.k") > F.col("all"))
    moves = stage(votes.select("shingle", F.col("most.into").alias("into"), (F.col("all").cast("double") * F.col("all")).alias("pairs")), "near-moves")
    union = shared.join(listed(moves.select("shingle", "into")), "shingle").groupBy("into", "row").agg(F.min("n").alias("n"), F.min("fp").alias("fp"))
    union = stage(union, "near-unions")
    sizes = union.groupBy("into").agg(F.count(F.lit(1)).alias("size"))
    worth = sizes.join(moves.groupBy("into").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("k")), "into")
    worth = listed(stage(worth.where((F.col("k") > 1) & (F.col("size").cast("double") * F.col("size") <= F.col("pairs"))).select("into", "size"), "near-worth"))
    gone = listed(stage(moves.join(worth, "into").select("shingle"), "near-moved"))
    # a name of their own, as the group that gave its name may have gone elsewhere
    together = union.join(worth, "into").select(F.xxhash64("into", F.lit(1)).alias("shingle"), "row", "n", "fp", "size")
    return stage(shared.select("shingle", "row", "n", "fp", "size").join(gone, "shingle", "left_anti").unionByName(together), "near-met")


def walked(shared: DataFrame, wide: DataFrame, roots: DataFrame, failed: DataFrame, every: bool = False) -> DataFrame:
    """Pairs (a, b) that the walks find between rows of different components (row, linked) among those in ``roots``, without the ``failed`` pairs (a, b).

    Of a small group all rows walk its tree. Of a large one, the rows outside the component that most of its rows belong to walk its
    trees: every pair of two components has such a row. Trees have SHARD rows at most and walkers come in packs of SHARD.
    """
    placed = shared.select("shingle", "row", "n", "fp", "size").join(listed(roots), "row")
    small = placed.where(F.col("size") <= RING).withColumn("shard", F.lit(0).cast("long")).withColumn("pack", F.lit(0).cast("long")).withColumn("role", F.lit(TREE | WALK))
    large = stage(placed.where(F.col("size") > RING), "near-large")
    counts = large.groupBy("shingle", "linked").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle").agg(F.max(F.struct("k", "linked")).alias("most"), F.sum("k").alias("all"))
    split = counts.select("shingle", F.col("most.linked").alias("giant"), F.ceil(F.col("all") / SHARD).alias("shards"), F.ceil((F.col("all") - F.col("most.k")) / SHARD).alias("packs")).where("packs > 0")
    some = large.join(stage(split, "near-split"), "shingle")
    all_ = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    tree = some.withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards"))).withColumn("pack", F.explode(all_("packs"))).withColumn("role", F.lit(TREE))
    walk = some.where("linked <> giant").withColumn("pack", F.pmod(F.xxhash64("row", F.lit(1)), F.col("packs"))).withColumn("shard", F.explode(all_("shards"))).withColumn("role", F.lit(WALK))
    columns = ["shingle", "shard", "pack", "row", "n", "fp", "linked", "role"]
    rows = small.select(*columns).unionByName(tree.select(*columns)).unionByName(walk.select(*columns)).join(wide, "row")
    lists = stage(failed.groupBy(F.col("a").alias("row")).agg(F.collect_list("b").alias("failed")), "near-failures")
    rows = rows.join(lists, "row", "left").select(*columns, "wide", "failed")
    rows = rows.repartition("shingle", "shard", "pack").sortWithinPartitions("shingle", "shard", "pack")
    return rows.mapInArrow(_grouped(_meet(every), 3), "a long, b long")


def near_pairs(held: DataFrame) -> DataFrame:
    """Pairs (a, b) of similar texts of ``held`` (staged; columns _row, text), enough to span every group of linked texts."""
    known = held.sparkSession.sparkContext.broadcast(common(held))
    rows = held.select("_row", "text").mapInArrow(_prefixes(known), "shingle long, row long, n int, fp long, packs int")
    rows = rows.select("shingle", F.pmod(F.xxhash64("row"), F.col("packs")).cast("int").alias("pack"), "row", "n", "fp", "packs")
    rows = rows.repartition("shingle", "pack").sortWithinPartitions("shingle", "pack")
    shared = stage(rows.mapInArrow(_grouped(_shared, 2), "shingle long, row long, n int, fp long, size long, other long, sig long"), "near-shared")
    # groups of the same rows have the same shingles, so each of their rows takes the same one of them
    partner = F.when(F.col("other") >= 0, F.col("other"))
    once = [F.min(c).alias(c) for c in ("shingle", "n", "fp", "size")] + [F.min(partner).alias("low"), F.max(partner).alias("high")]
    shared = stage(shared.groupBy("row", "sig").agg(*once), "near-groups")
    wide = stage(_texts_of(held, shared.select("row")).mapInArrow(_wide, "row long, wide binary"), "near-wide")
    members = wide.select("row")

    def joined(tried: DataFrame) -> DataFrame:
        """(row, linked): the component of every row that shares a shingle."""
        found = components(tried.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v")))
        return stage(members.join(found.toDF("row", "root"), "row", "left").select("row", F.coalesce("root", "row").alias("linked")), "near-linked")

    # in large groups, a text meets two others first
    ring = shared.where("low is not null").groupBy("row").agg(F.array(F.min("low"), F.max("high")).alias("others")).select("row", F.explode("others").alias("other"))
    tried = verify(held, ring.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")))
    shared = merged(shared)
    failures = lambda: tried.where("not ok").select("a", "b")
    new = verify(held, walked(shared, wide, joined(tried), failures()))
    tried = stage(tried.unionByName(new), "near-tried")
    # a pair left out of a forest joins what the forest's pairs join, but where one of these failed: components at the ends of
    # failed pairs are spanned again without them, and at last all their pairs are tried
    for turn in range(1, ROUNDS + 1):
        if tried.where("not ok").isEmpty():
            break
        roots = joined(tried)
        ends = failures().select(F.explode(F.array("a", "b")).alias("row")).distinct().join(roots, "row").select("linked").distinct()
        left = roots.join(stage(ends, "near-failed"), "linked", "left_semi").select("row", "linked")
        new = verify(held, walked(shared, wide, left, failures(), every=turn == ROUNDS))
        if new.isEmpty():
            break
        tried = stage(tried.unionByName(new), "near-tried")
    return tried.where("ok").select("a", "b")
