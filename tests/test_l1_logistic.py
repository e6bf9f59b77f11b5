import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import l1_logistic as L1
from riskloom.operators import models as MD


def frame(spark, n=400, width=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)) * np.arange(1, width + 1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 - 0.4 * x[:, 2] - 0.3)))).astype(int)
    rows = [(i, int(c), i % 3, *map(float, v)) for i, (c, v) in enumerate(zip(y, x))]
    names = [f"F{j}" for j in range(width)]
    return spark.createDataFrame(rows, ["id", "y", "fold", *names]), names, x, y


def descent(x, y, penalty):
    """Proximal gradient descent, very many small steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w, rate = np.zeros(a.shape[1]), 4.0 / np.linalg.norm(a, 2) ** 2
    momentum, t = w.copy(), 1.0
    for _ in range(60_000):
        g = a.T @ (1 / (1 + np.exp(-(a @ momentum))) - y)
        new = momentum - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def test_folds_match_single_fits(spark):
    df, names, x, y = frame(spark)
    got = L1.fit_folds(L1.training_rows(df, names, "y"), len(names), 10.0, [0, 1, 2, -1])
    fold = np.arange(len(y)) % 3
    for m, out in enumerate([0, 1, 2, -1]):
        want = descent(x[fold != out], y[fold != out], 10.0)
        assert np.abs(got[m] - want).max() < 1e-6
    assert (got[-1] == 0).any()  # the penalty removes some


def test_probability_is_the_model(spark):
    df, names, x, _ = frame(spark)
    w = np.array([0.5, 1.0, 0.0, -2.0, 0.0, 0.0, 0.25])
    got = [r.p for r in df.orderBy("id").select(L1.probability(w, names).alias("p")).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-(w[0] + x @ w[1:]))))


def test_elimination_with_another_estimator(spark):
    df, names, _, _ = frame(spark, n=90)
    asked = []

    def by_name(rows, width, models):
        asked.append(width)
        return np.tile(np.arange(width + 1, dtype=float)[::-1], (len(models), 1))

    got = {f: (r, s) for f, r, s in MD.rfe_cv(df, names, "y", "id", step=0.2, min_features=3, estimator=by_name)}
    assert asked == [6, 5, 4, 3]
    assert all(got[f][1] for f in names[:3])  # the last columns have the least weights and go first
    assert MD.eliminated_in(names, {f: len(names) - i for i, f in enumerate(names)}, 0.2, 3) == {"F0": 0, "F1": 0, "F2": 0, "F3": 3, "F4": 2, "F5": 1}


def test_selection_by_l1(spark):
    df, names, _, _ = frame(spark)
    got = {f: s for f, _, s in MD.rfe_cv(df, names, "y", "id", min_features=2)}
    assert got["F0"] and got["F2"]
    assert df.agg(F.count("*")).first()[0] == 400


def test_elimination_reads_few_tasks(spark):
    df, names, _, _ = frame(spark, n=90)
    tasks = []

    def by_name(rows, width, models):
        tasks.append(rows.rdd.getNumPartitions())
        return np.tile(np.arange(width + 1, dtype=float)[::-1], (len(models), 1))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        MD.rfe_cv(df, names, "y", "id", step=0.2, min_features=5, estimator=by_name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tasks == [1, 1]  # 90 rows: one task, whatever the shuffle partitions
