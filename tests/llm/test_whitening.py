import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import queries
from spanloom.llm import whitening as Z

SCHEMA = "vec_id long, embedding array<float>, label int, n double, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 0.5, "x") for i, v in rows], SCHEMA)


def whitened(df, components=Z.COMPONENTS):
    rows = Z.whole(df)
    model = Z.fit(rows)
    return model, sorted(Z.whiten(rows, model, components).collect(), key=lambda r: (r.vec_id is None, r.vec_id)), Z.identity_error(rows, model, components)


def test_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(Z, "FAN_IN", 3)
    monkeypatch.setattr(Z, "BLOCK", 8 * 6 * 50)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (900, 6)).astype(np.float32) @ np.diag([5, 3, 2, 1, 0.5, 0.25]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (2003, [float("inf")])]
    rows += [(None, x[0].tolist())] + [(3000 + i, x[1].tolist()) for i in range(300)]  # a null id, many copies
    model, got, error = whitened(frame(spark, rows).repartition(17))
    whole = np.array([r[1] for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])], np.float32).astype(float)
    y = np.floor(64 * whole) + 1_000_000
    n = len(y)
    values, vectors = np.linalg.eigh(np.cov(y.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1].T
    assert len(got) == n == model.n and model.sums == [int(s) for s in y.sum(axis=0)]
    assert np.allclose(model.values, values, rtol=1e-10) and np.allclose(np.abs((model.vectors * vectors).sum(axis=1)), 1, atol=1e-9)
    assert error < 1e-9 and abs(sum(model.explained) - 1) < 1e-12
    by_id = {r.vec_id: r for r in got if r.vec_id is not None}
    for i in (0, 17, 899, 3007):
        t = n * y[i if i < 900 else 1] - y.sum(axis=0)
        assert by_id[i].deviation == sum(int(c) ** 2 for c in t)
        assert np.allclose(by_id[i].whitened, model.vectors @ (t / n) / np.sqrt(values), atol=1e-8)


def test_merging_is_lossless():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (200, 5)) + 10**6

    def state(part):
        sums = part.sum(axis=0).tolist()
        return Z.Spread(len(part), sums, Z.axes_of(Z.centred(part, len(part), sums) / len(part)))

    one, parts = state(x), [state(x[a:b]) for a, b in ((0, 1), (1, 4), (4, 120), (120, 200))]
    merged = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3]))
    assert merged.sums == one.sums and np.allclose(merged.axes.T @ merged.axes, one.axes.T @ one.axes, rtol=1e-11, atol=1e-7)


def test_ragged_constant_and_few_vectors(spark):
    model, got, error = whitened(frame(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0]), (3, [])]))
    assert model.sums == [3 * 10**6 + 192, 3 * 10**6 + 128, 3 * 10**6 + 192]
    assert [c is None for c in got[0].whitened] == [False, False, True] and error < 1e-9  # three vectors span two dimensions
    model, got, error = whitened(frame(spark, [(i, [0.5, 0.5]) for i in range(4)]))
    assert error == 0.0 and model.explained == [0.0, 0.0] and {(r.deviation, *r.whitened) for r in got} == {(0, None, None)}
    assert Z.fit(Z.whole(frame(spark, []))) is None and Z.fit(Z.whole(frame(spark, [(1, []), (2, None)]))) is None


def test_far_entries(spark):
    model, got, error = whitened(frame(spark, [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, 1.5])]))
    assert model.sums[0] == 3 * 10**6 and got[0].deviation == Z.MOST and got[2].deviation == 0


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 1.0]), (2, [0.25, 3.0]), (5, [1.5, 2.0])]])
def test_query_columns(spark, tmp_path, rows):
    frame(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op13_whiten_svd(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 2 * len(rows) and out.where(F.col("identity_error") > 1e-4).count() == 0
