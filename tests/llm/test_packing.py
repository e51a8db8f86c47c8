from collections import Counter
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import packing as P


def padding(hist, ends):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in hist.items())


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_are_optimal(hist, k):
    ends = P.boundaries(list(hist), list(hist.values()), k)
    xs = sorted(hist)
    best = min(padding(hist, [*c, xs[-1]]) for c in combinations(xs[:-1], min(k, len(xs)) - 1))
    assert len(ends) <= k and padding(hist, ends) == best


def test_pack(odd_docs):
    got = P.pack(odd_docs, buckets=3, budget=40).collect()
    assert len(got) == odd_docs.count()
    batches = Counter((r.bucket, r.batch) for r in got)
    for r in got:
        assert r.n_tokens <= r.bucket_tokens and r.slot < max(1, 40 // max(1, r.bucket_tokens))
        assert batches[r.bucket, r.batch] * r.bucket_tokens <= 40 or batches[r.bucket, r.batch] == 1 or r.bucket_tokens == 0
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)
    assert all(b == 0 or (k, b - 1) in batches for k, b in batches)


def test_boundaries_of_long_histograms():
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(0, 10**6, 700))
    c = rng.integers(1, 1000, len(x))
    ends = P.boundaries(x, c, 6)
    many, words = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best = np.concatenate([[0], x * many[1:] - words[1:]]).astype(float)
    for layer in range(2, 7):
        now = np.full(len(best), np.inf)
        for j in range(layer, len(best)):
            i = np.arange(layer - 1, j)
            now[j] = (best[i] + x[j - 1] * (many[j] - many[i]) - (words[j] - words[i])).min()
        best = now
    assert padding(dict(zip(x.tolist(), c.tolist(), strict=True)), ends) == best[-1]
    many = P.boundaries(np.arange(200_000), np.ones(200_000), 16)
    assert len(many) == 16 and many[-1] == 199_999 and np.ptp(np.diff([-1, *many])) <= 2


def test_empty(no_docs):
    assert P.pack(no_docs).count() == 0
