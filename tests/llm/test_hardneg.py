import math
import random

import numpy as np

from spanloom.llm import hardneg as H

SCHEMA = "vec_id long, embedding array<float>, label int, v string, score double"


def plain(rows, k=5, n=10):
    ok = []
    for i, v, y, *_ in rows:
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]))
    anchors = {}
    for i, y, v in ok:
        if i % 100 == 0:
            anchors[i] = max(anchors.get(i, (y, v)), (y, v))
    out = []
    for i, (y, q) in anchors.items():
        scored = sorted((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(q, v, strict=False)))), j, z) for j, z, v in ok if j != i)
        for p, j, _ in [s for s in scored if s[2] == y][:k]:
            fit = [(s, m) for s, m, z in scored if z != y and 30 * -p <= 100 * -s <= 90 * -p][:n]
            out += [(i, j, r + 1, m, -p, -s) for r, (s, m) in enumerate(fit)]
    return sorted(out)


def run(spark, rows):
    v = H.labelled(spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA))
    return sorted(tuple(r) for r in H.mine(v.where("vec_id % 100 = 0"), v).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 64)
    monkeypatch.setattr(H, "QUERIES", 3)
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)], rng.randrange(10)) for i in range(900)]
    rows += [(900 + i, [0.5] * 6, i % 3) for i in range(120)]  # copies: ties by id, under several labels
    rows += [(2000, None, 1), (2001, [1.0, None, 2.0], 1), (2100, [float("nan")] * 6, 1), (2003, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (2200, [1.0] * 6, None), (2300, [], 1), (2301, [3.0], 2)]
    rows += [(100, [0.25] * 6, 3), (33, [2.0] * 6, 4), (33, [2.0] * 6, 4)]  # a repeated anchor, repeated rows
    assert run(spark, rows) == plain(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(6)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.choice([-1, 1]) * rng.uniform(1, 2) * 2.0 ** rng.randrange(17, 21)) for _ in range(3)], rng.randrange(3)) for i in range(400)]
    rows += [(400 + i, [f32(rng.choice([-1, 1]) * 3e38), 0.5, 0.0], i % 2) for i in range(20)]
    assert run(spark, rows) == plain(rows)


def test_no_rows_and_one_label(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0], 1), (101, [1.0], 1)]) == []
    assert run(spark, [(100, [1.0], 1), (101, [-1.0], 1), (102, [-0.5], 2)]) == []  # a negative positive score has no band
    assert run(spark, [(100, [0.0], 1), (101, [1.0], 1), (102, [5.0], 2)]) == [(100, 101, 1, 102, 0, 0)]


def test_planes_rebuild_the_rows_and_drop_candidates():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 60, (500, 16)))
    p = H.Planes(x)
    assert np.array_equal(p.signs() + sum(2.0**level * p.plane(level) for level in range(p.bits)), x)
    read = []
    plane = p.plane
    block = H.Block(np.arange(500), np.zeros(500, np.int64), x)
    block.planes.plane = lambda level: read.append(level) or plane(level)
    best = int((x @ x[0]).max())
    q, none = x[:1], np.array([-1])
    far = np.array([[[best + 20_000, best + 30_000]]], np.int64)
    assert block.search(none, np.array([1]), q, far, np.full((1, 1), -np.inf), 3, False) == [] and min(read) > 0  # stops before the last bits
    open_ = np.array([[[H.LEAST, H.MOST]]], np.int64)
    got = block.search(none, np.array([1]), q, open_, np.full((1, 1), -np.inf), 3, False)
    assert [s for _, _, s, _ in got] == sorted((x @ x[0]).astype(int).tolist(), reverse=True)[:3]
