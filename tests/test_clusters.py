import numpy as np
import pytest

from spanloom.operators import clusters as C


def plain(x, stop):
    """Average linkage on the matrix of distances."""
    d = 1 - x @ x.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min(((float(d[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if stop(best[0], len(groups)):
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def as_sets(label):
    return {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())}


@pytest.mark.parametrize("seed", range(4))
def test_linkage_against_all_distances(seed):
    rng = np.random.default_rng(seed)
    x = C.directions(rng.normal(size=(45, 6)) + 3 * rng.normal(size=(5, 6))[rng.integers(0, 5, 45)], None)
    merges = C.linkage(x)
    assert len(merges) == 44 and all(a[0] <= b[0] for a, b in zip(merges, merges[1:], strict=False))
    for below in (0.1, 0.5, 0.9):
        assert as_sets(C.cut(45, merges, None, below)) == plain(x, lambda d, _, t=below: d >= t)
    for k in (1, 3, 10, 45):
        assert as_sets(C.cut(45, merges, k, None)) == plain(x, lambda _, n, k=k: n <= k)


def test_silhouette_against_the_definition():
    rng = np.random.default_rng(7)
    x, label = C.directions(rng.normal(size=(30, 5)), None), np.array([0, 1, 2] * 9 + [3, 2, 1])
    d = 1 - x @ x.T
    s = []
    for i in range(30):
        own = [j for j in range(30) if label[j] == label[i] and j != i]
        a, b = (d[i, own].mean() if own else 0), min(d[i, label == k].mean() for k in range(4) if k != label[i])
        s.append((b - a) / max(a, b) if own else 0.0)
    assert abs(C.silhouette(x, label) - np.mean(s)) < 1e-12
    assert C.silhouette(x, np.zeros(30, int)) == 1.0 and C.silhouette(x, np.arange(30)) == 0.0


def test_axes_keep_the_asked_variance():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 1)) @ np.ones((1, 6)) + 0.01 * rng.normal(size=(200, 6))
    assert C.directions(x).shape[1] == 1 and C.directions(x, 0.99999999).shape[1] == 6 and np.allclose(np.linalg.norm(C.directions(x), axis=1), 1)


def test_groups_by_key(spark):
    rng = np.random.default_rng(3)
    centre = np.array([[4.0] * 5, [-4.0] * 5, [4.0, -4.0, 4.0, -4.0, 4.0]])
    rows = [(m, i, (centre[i % k] + 0.2 * rng.normal(size=5)).tolist()) for m, k in ((1, 3), (2, 2)) for i in range(30)]
    rows += [(1, 100, None), (1, 101, [float("nan")] * 5), (1, 102, [1.0, None, 1.0, 1.0, 1.0]), (3, 1, [1.0, 2.0, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "m int, id int, v array<double>").repartition(4)
    got = {(r.m, r.id): r for r in C.voice_groups(df, ["m"], below=1.0).collect()}
    assert all(got[m, i].cluster == i % k for m, k in ((1, 3), (2, 2)) for i in range(30)) and got[1, 0].silhouette > 0.3
    assert [got[1, i].cluster for i in (100, 101, 102)] == [-1] * 3 and got[1, 100].silhouette is None and (got[3, 1].cluster, got[3, 1].silhouette) == (0, 1.0)
    two = {r.id: r.cluster for r in C.voice_groups(df.where("m = 1"), ["m"], below=1.0, most=2).collect() if r.cluster >= 0}
    assert set(two.values()) == {0, 1} and all(len({two[i] for i in range(k, 30, 3)}) == 1 for k in range(3))
    assert len({r.cluster for r in C.voice_groups(df.where("m = 2"), ["m"], below=1.0, fewest=4).collect()}) == 4
    assert len({r.cluster for r in C.voice_groups(df.where("m = 2"), ["m"], expected=5).collect()}) == 5
    assert {r.cluster for r in C.voice_groups(df.where("m = 2"), ["m"], most=1).collect()} == {0}
    assert C.voice_groups(df.limit(0), ["m"]).count() == 0
