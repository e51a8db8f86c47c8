import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import simhash as S
from spanloom.llm.bktree import BKForest


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                up[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), []).append(n)
    return list(out.values())


def test_fingerprint(odd_docs):
    for r in odd_docs.collect():
        assert S.fingerprint(r.text) == slow_print(r.text)


def test_groups(odd_docs):
    rows = odd_docs.collect()
    got = S.near_groups(odd_docs).collect()
    assert len(got) == len(rows)
    by_print = {}
    for r in rows:
        by_print.setdefault(slow_print(r.text), []).append(r.doc_id)
    want = {}
    for group in slow_components(by_print, lambda a, b: bin(a ^ b).count("1") <= 4):
        least = min((i for p in group for i in by_print[p] if i is not None), default=None)
        want |= {f"{p:016x}": least for p in group}
    assert {r.fingerprint: r.component_id for r in got} == want


def test_empty(no_docs):
    assert S.near_groups(no_docs).count() == 0 and S.drop_near(no_docs).count() == 0


def bits(a, b):
    return bin((int(a) ^ int(b)) & (2**64 - 1)).count("1")


@pytest.mark.parametrize("trees", [1, 5, 40])
def test_walks_find_every_pair(trees):
    rng = np.random.default_rng(trees)
    base = rng.integers(0, 2**63, 20, np.uint64)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 20, np.uint64)) for _ in range(10)] + [base]))
    _, tree = np.unique(np.sort(rng.integers(0, trees, len(prints))), return_inverse=True)
    forest, place = BKForest.of(prints, tree)
    for parent, edge, node in zip(forest.link // 128, forest.link % 128, range(len(prints)), strict=True):
        assert forest.link[node] < 0 or bits(forest.prints[parent], forest.prints[node]) == edge
    for radius in (0, 4, 30):
        seen = []
        found = {(int(q), int(place[n])) for qs, ns in forest.walk(prints, forest.roots[tree], radius, seen) for q, n in zip(qs, ns, strict=True)}
        assert found == {(i, j) for i in range(len(prints)) for j in range(len(prints)) if tree[i] == tree[j] and bits(prints[i], prints[j]) <= radius}
        assert sum(seen) <= sum(int(n) ** 2 for n in np.bincount(tree))
    parts = [BKForest.of(prints[tree == k], np.zeros((tree == k).sum(), np.int64))[0] for k in range(tree.max() + 1)]
    one, number = BKForest.joined([(f.prints, f.link) for f in parts])
    assert np.array_equal(np.sort(one.link), one.link) and len(one.roots) == len(parts)
    sizes = [len(f.prints) for f in parts]
    root = np.repeat(number[np.cumsum(sizes) - sizes], sizes)
    pairs = {(int(prints[q]), int(one.prints[n])) for qs, ns in one.walk(prints, root, 4) for q, n in zip(qs, ns, strict=True)}
    assert pairs == {(int(p), int(q)) for i, p in enumerate(prints) for j, q in enumerate(prints) if tree[i] == tree[j] and bits(p, q) <= 4}


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_linked_fingerprints_share_a_key(spark, blocks):
    rng = random.Random(blocks)
    rows = []
    for i in range(60):
        p, q = rng.getrandbits(64), 0
        for b in rng.sample(range(64), 4):
            q |= 1 << b
        rows.append((i, p - 2**63, (p ^ q) - 2**63))
    found = spark.createDataFrame(rows, "i int, p long, q long").select(S.keys(F.col("p"), blocks).alias("p"), S.keys(F.col("q"), blocks).alias("q")).collect()
    assert all(set(r.p) & set(r.q) for r in found)


@pytest.mark.parametrize("shard,blocks,wide", [(512, None, 1 << 20), (7, None, 1 << 20), (7, 6, 0)])
def test_links_span_components(spark, monkeypatch, shard, blocks, wide):
    rng = random.Random(shard)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 40)):  # chains of small steps, some beyond the radius
            prints.add(p)
            for _ in range(rng.randrange(1, 7)):
                p ^= 1 << rng.randrange(64)
    monkeypatch.setattr(S, "SHARD", shard)
    monkeypatch.setattr(S, "BROADCAST_TREES", wide)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    roots = {r.node: r.root for r in S.components(S.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), blocks=blocks)).collect()}
    got = {}
    for s in signed:
        got.setdefault(roots.get(s, s), set()).add(s)
    want = slow_components(signed, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_near_rows_of_odd_tables(odd_docs, no_docs):
    clash = odd_docs.withColumn("_row", F.lit("mine")).withColumn("_ROW2", F.lit(1))
    kept = S.drop_near(clash)
    assert kept.columns == clash.columns and {r._row for r in kept.collect()} == {"mine"}
    assert S.drop_near(no_docs).count() == 0
