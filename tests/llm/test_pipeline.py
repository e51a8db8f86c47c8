from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from spanloom.llm import packing, quality
from spanloom.llm.exact_dedup import normal
from tests.llm.test_mixing import plain_targets
from tests.llm.test_shingles import groups

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for i, (_, step) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        step(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_against_plain_versions(spark, stages):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good, exact, near, mixed, packed = [s.collect() for s in stages]
    scores = {r.doc_id: r.score for r in quality.score(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert {r.doc_id for r in good} == {i for i, s in scores.items() if s >= 0.5}
    assert Counter(normal(r.text) for r in exact) == Counter({normal(r.text): 1 for r in good})
    found = groups([r.text for r in exact])  # five words, four fifths
    kept = {r.doc_id for r in near}
    assert len(near) == len(found) and all(sum(exact[i].doc_id in kept for i in g) == 1 for g in found)
    size, took, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    words = lambda r: len((r.text or "").encode().split())
    for r in near:
        size[r.source] += words(r)
        longest[r.source] = max(longest[r.source], words(r))
    for r in mixed:
        took[r.source] += words(r)
    names = sorted(size)
    for name, target in zip(names, plain_targets([size[n] for n in names]), strict=True):
        assert abs(took[name] - target) <= longest[name] + 1
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert Counter(r.doc_id for r in packed) == Counter(r.doc_id for r in mixed)
    lengths = Counter(words(r) for r in mixed)
    ends = packing.boundaries(list(lengths), list(lengths.values()))
    assert all(r.bucket_tokens == min(e for e in ends if e >= r.n_tokens) for r in packed)
    assert all(s.columns == P.COLUMNS for s in stages[:-1])


def test_run_is_the_stages(spark, stages):
    assert Counter(map(tuple, P.run(spark, DATA).select("doc_id", "n_tokens", "bucket").collect())) == Counter(map(tuple, stages[-1].select("doc_id", "n_tokens", "bucket").collect()))
