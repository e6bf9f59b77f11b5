import numpy as np
import pytest

from riskloom.operators import smote as SM


def exact(v, k):
    out = {}
    for i, x in enumerate(v):
        d = np.sqrt(((v - x) ** 2).sum(axis=1))
        out[i + 1] = [j + 1 for _, j in sorted((round(float(e), 9), j) for j, e in enumerate(d) if j != i)[:k]]
    return out


def points(spark, v):
    return spark.createDataFrame([(i + 1, x.tolist()) for i, x in enumerate(v)], "pick bigint, v array<double>")


@pytest.mark.parametrize("shape", ["clusters", "flat", "copies"])
def test_pivots_are_exact(spark, shape):
    rng = np.random.default_rng(1)
    if shape == "clusters":
        v = np.concatenate([rng.standard_normal((150, 6)) * 0.1 + c for c in rng.standard_normal((8, 6)) * 50])
    elif shape == "flat":
        v = rng.standard_normal((300, 20))
    else:
        v = np.round(rng.standard_normal((400, 2)), 1)
        v[:150] = 0.5
    v = v[rng.permutation(len(v))]
    got: dict[int, list[int]] = {}
    for r in sorted(SM.knn_minority(points(spark, v), len(v), v.shape[1], 3).collect(), key=lambda r: (r.i, r.rank)):
        got.setdefault(r.i, []).append(r.j)
    want = exact(v, 3)
    if shape == "copies":  # many equal distances: compare these
        d = lambda i, js: [round(float(np.sqrt(((v[i - 1] - v[j - 1]) ** 2).sum())), 9) for j in js]
        assert {i: d(i, js) for i, js in got.items()} == {i: d(i, js) for i, js in want.items()}
    else:
        assert got == want


def test_clusters_meet_few_pairs(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.standard_normal((200, 6)) * 0.1 + c for c in rng.standard_normal((20, 6)) * 50])
    pairs = SM.neighbour_pairs(points(spark, v[rng.permutation(len(v))]), len(v), 3).count()
    assert pairs < 0.1 * len(v) ** 2


def test_few_rows(spark):
    for n in (1, 2, 3):
        v = np.arange(n, dtype=float)[:, None]
        assert SM.knn_minority(points(spark, v), n, 1, 3).count() == n * (n - 1)


def test_tasks_hand_on_the_nearest_alone(spark, monkeypatch):
    """k pairs a row leave the tasks, not all that were measured, and groups of blocks meet one another (F2)."""
    monkeypatch.setattr(SM, "BLOCK", 16)
    monkeypatch.setattr(SM, "GROUP", 3)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 12)) * 10.0 ** rng.integers(-3, 4, (400, 1))
    v[5:40] = v[4]
    pairs = SM.neighbour_pairs(points(spark, v), len(v), 3)
    rows = [(r.i, r.j, r.dist) for r in pairs.collect()]
    assert len(rows) == 1200
    for i, x in enumerate(v):
        total = np.zeros(len(v))
        for column, value in zip(v.T, x):
            total += (value - column) ** 2
        want = sorted((float(np.sqrt(d)), j + 1) for j, d in enumerate(total) if j != i)[:3]
        assert sorted((d, j) for r, j, d in rows if r == i + 1) == want


def test_rows_with_nulls_have_null_distances(spark):
    pts = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [None, 1.0]), (4, [0.0, 3.0])], "pick bigint, v array<double>")
    got = {(r.i, r["rank"]): (r.j, r.dist) for r in SM.knn_minority(pts, 4, 2, 2).collect()}
    assert all(d is None for (i, _), (_, d) in got.items() if i == 3)
    assert all(got[i, k][1] is not None for i in (1, 2, 4) for k in (1, 2) if (i, k) in got and got[i, k][0] != 3)
