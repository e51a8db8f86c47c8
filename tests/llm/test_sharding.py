import zlib
from collections import defaultdict

from spanloom.llm import sharding as S


def check(docs, even):
    rows, got = docs.collect(), S.shard(docs).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    slots, weight = defaultdict(list), dict.fromkeys(range(16), 0)
    for r in got:
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        weight[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if even:
        mean = sum(weight.values()) / 16
        assert max(weight.values()) < even * mean and min(weight.values()) > (2 - even) * mean
    return got


def test_odd(odd_docs):
    check(odd_docs, None)


def test_even_and_together(spark):
    rows = [(i, f"text {i % 3000} " + "x" * (i % 3000 * 7 % 211), "en" if i % 5 else None, f"s{i % 7}") for i in range(6000)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 1.05)
    homes = defaultdict(set)
    for r in got:
        homes[r.doc_id % 3000].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) == 0


def test_hot_group_is_cut(spark):
    rows = [(i, "same text here" if i % 2 else f"other {i} text", "en", "s") for i in range(4000)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 1.25)


def test_empty(no_docs):
    assert S.shard(no_docs).count() == 0


def test_whole_names_part_the_sources(spark):
    rows = [(i, f"text {i}", "en", f"source-{'ab'[i % 2]}") for i in range(4000)]
    home = defaultdict(set)
    source = {r[0]: r[3] for r in rows}
    for r in check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 1.1):
        home[r.shard].add(source[r.doc_id])
    assert sum(len(s) == 1 for s in home.values()) >= 14


def test_against_plain_tree(spark):
    """Leaves of the histograms' tree against medians over sorted lists."""
    import random

    rng = random.Random(4)
    atoms = [(i, rng.randrange(50) * S.TIES + i, rng.randrange(1 << 20) * S.TIES + i, float(rng.randrange(1, 50))) for i in range(3000)]
    df = spark.createDataFrame(atoms, "id int, a long, b long, weight double")
    got = {r.id: r.shard for r in S.kd_splits(df, ["a", "b"], 8).collect()}

    def split(rows, depth):
        if depth == 0:
            return [rows]
        dim = max((1, 2), key=lambda d: (max(r[d] for r in rows) // S.TIES - min(r[d] for r in rows) // S.TIES, -d))
        rows, half, below, at = sorted(rows, key=lambda r: r[dim]), sum(r[3] for r in rows) / 2, 0.0, 0
        while below + rows[at][3] < half:
            below += rows[at][3]
            at += 1
        at += abs(below + rows[at][3] - half) <= abs(half - below)
        return split(rows[:at], depth - 1) + split(rows[at:], depth - 1)

    want = {r[0]: leaf for leaf, rows in enumerate(split(atoms, 3)) for r in rows}
    moved = sum(got[i] != want[i] for i in want)
    assert moved <= 0.01 * len(atoms)  # the last bin's width
