import math
import random

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import topk as K


def plain(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in ok if i % 50 == 0}.items():
        scored = sorted(((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(q, v, strict=False)))), j) for j, v in ok if j != i))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def run(spark, rows):
    vectors = K.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    return sorted(tuple(r) for r in K.top_k(vectors.where("vec_id % 50 = 0"), vectors).select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(700)]
    rows += [(700 + i, [0.5] * 6) for i in range(60)] + [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6), (950, []), (951, [3.0])]
    assert run(spark, rows) == plain(rows)


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [-1.0, 0.5]), (3, [0.0, 0.0])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_walk_stops_early():
    rng = np.random.default_rng(0)
    x = np.floor(rng.exponential(10, (2000, 3)) ** 2)
    lists, q = K.SortedLists(np.arange(2000), x), np.array([[2.0, 4.0, 1.0]])
    (met,) = lists.search(np.array([-1]), q, np.array([-np.inf]), 5)
    assert [score for score, _ in met] == sorted((x @ q[0]).tolist(), reverse=True)[:5]
    assert lists.bounds(q, 1000)[0] < met[-1][0]


def test_repeated_query(spark):
    v = K.whole_vectors(spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [1.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in K.top_k(v.where("vec_id = 0"), v).collect()] == [(0, 1, 1, 512 * 256)]
    assert v.select(F.max("v")).count() == 1


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.choice([-1, 1]) * rng.uniform(1, 2) * 2.0 ** rng.randrange(18, 22)) for _ in range(3)]) for i in range(300)]
    rows += [(300 + i, [f32(rng.choice([-1, 1]) * 3e38), f32(rng.uniform(-1, 1)), 0.0]) for i in range(51)]
    rows += [(1000, [1 / 256, 0.0, 0.0]), (1001, [0.0, 0.0, 0.0]), (1050, [f32(2.0**30), 1 / 256, 0.0]), (1002, [f32(2.0**20), 5 / 256, 0.0]), (1003, [f32(2.0**20), 4 / 256, 0.0])]
    assert run(spark, rows) == plain(rows)
