import re
from collections import defaultdict
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import mixing as M


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=4), st.integers(0, 60))
def test_fit_is_optimal(hist, budget):
    lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
    took = M.fit(lengths, counts, budget)
    assert ((took >= 0) & (took <= counts)).all()
    sums = {sum(l * k for l, k in zip(lengths, ks, strict=True)) for ks in product(*[range(c + 1) for c in counts])}
    assert abs(int((took * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_fit_reaches_over_where_that_is_nearer():
    assert int((M.fit(np.array([1_000_000, 500]), np.array([1, 1]), 900_000) * [1_000_000, 500]).sum()) in (1_000_000, 1_000_500)
    assert M.fit(np.array([1000]), np.array([1]), 999).tolist() == [1] and M.fit(np.array([1000]), np.array([1]), 400).tolist() == [0]


def test_fit_large_budgets():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.01, 0.37, 0.999):
        budget = int(total * share)
        took = M.fit(lengths, counts, budget)
        assert (took <= counts).all() and int((took * lengths).sum()) == budget


def plain_targets(sizes, weights=(5, 2, 1)):
    """By rounds over a list: hold those above three sizes, share the excess again."""
    left, out = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        share = {i: left * weights[i % 3] / sum(weights[j % 3] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i]]
        for i in over or open_:
            out[i] = float(3 * sizes[i]) if over else share[i]
        left -= sum(3 * sizes[i] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    return out


def test_targets(spark):
    rng = np.random.default_rng(2)
    for sizes in ([100, 100, 100], [10, 100, 1000, 0], [], [0, 0], [1, 5000, 3, 0, 7, 2_000_000, 1], rng.integers(0, 10**6, 60).tolist() + rng.integers(0, 50, 60).tolist()):
        names = sorted({f"s{'ab'[i % 2]}{i:03d}é" for i in range(len(sizes))} | set())[: max(0, len(sizes) - 1)] + [None] * bool(sizes)
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long").repartition(5)
        got = {r.source: r.target for r in M.targets(df).collect()}
        want = dict(zip(names, plain_targets(sizes), strict=True))
        assert set(got) == set(want) and all(abs(got[n] - want[n]) <= 1e-6 * max(1, want[n]) for n in want)


def check(docs):
    rows = docs.collect()
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r.doc_id), size(r.text)) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, plain_targets([sizes[n] for n in names]), strict=True))
    took = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken == r["size"] * r.copies and r.copies <= 3
        took[r.source] += r.taken
    longest = defaultdict(int)
    for r in got:
        longest[r.source] = max(longest[r.source], r["size"])
    assert all(abs(took[n] - want[n]) <= longest[n] + 1 for n in names)
    return got


def test_mix_odd(odd_docs):
    assert sorted(map(str, check(odd_docs))) == sorted(map(str, check(odd_docs)))


def test_mix_hot_length(spark):
    rows = [(i, "a b c", "hot" if i % 3 else "cold") for i in range(600)] + [(1000 + i, "w " * i, "cold") for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_empty(no_docs):
    assert M.mix(no_docs).count() == 0
