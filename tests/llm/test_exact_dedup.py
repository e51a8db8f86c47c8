import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import exact_dedup as X


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[X.normal(r.text)].append(r)
    out = []
    for text, g in groups.items():
        keep = max((r.doc_id for r in g if r.doc_id is not None), default=None)
        out += [(r.doc_id, keep, len(g), hashlib.sha256(text).hexdigest()) for r in g]
    return sorted(out, key=str)


def test_groups(odd_docs):
    got = X.exact_groups(odd_docs).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == plain(odd_docs.collect())
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append(r)
    assert {r.text_sha256 for r in got} == set(kept) and all(len(v) == 1 and v[0].doc_id == v[0].keep_id for v in kept.values())


def test_empty(no_docs):
    assert X.exact_groups(no_docs).count() == 0 and X.drop_exact(no_docs).count() == 0


def test_drop_keeps_columns(odd_docs):
    out = X.drop_exact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == len({X.normal(r.text) for r in odd_docs.collect()})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5), min_size=1, max_size=30), min_size=1, max_size=4))
def test_filters_merge_losslessly(parts):
    filters = [X.CountingQuotientFilter.of(np.array(p, np.uint64)) for p in parts]
    merged = X.CountingQuotientFilter.from_blocks([b for f in filters for b in f.blocks(4)], 4)
    both = filters[0].merge(filters[-1])
    want = defaultdict(int)
    for p in parts:
        for x in p:
            want[x] += 1
    values, counts = merged.items()
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == dict(want) and values.tolist() == sorted(want)
    assert all(merged.count(x) == n for x, n in want.items()) and merged.count(77) == want.get(77, 0)
    assert all(both.count(x) == parts[0].count(x) + parts[-1].count(x) for x in want)
    # the structure: every run sorted, in a row, ending where it says, one end for each occupied quotient
    assert merged.occupied.sum() == merged.ends.sum() == len({x >> (64 - merged.bits) for x in want}) and len(merged) == len(want)


def test_filter_spills_over(spark, monkeypatch):
    keys = spark.createDataFrame([(i % 50,) for i in range(120)] + [(-1,)], "fp long")
    got = {r.fp: r.n for r in X.repeated_fingerprints(keys).collect()}
    assert got == {i: 3 if i < 20 else 2 for i in range(50)}


def test_blocks_grow_with_the_texts():
    assert X.block_bits(0) == 4 and X.block_bits(10**11) >= 18


def test_drop_keeps_clashing_columns(odd_docs):
    from pyspark.sql import functions as F

    out = X.drop_exact(odd_docs.withColumn("_row", F.lit("mine")))
    assert out.columns == [*odd_docs.columns, "_row"] and {r._row for r in out.collect()} == {"mine"}
