"""Property checks for evaluation, balancing, MI and the isolation forest."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluate as EV
from riskloom.operators import isolation as IF
from riskloom.operators import models as MD
from riskloom.operators import mutual_info as MI
from riskloom.sources.fixtures import feature_matrix
from riskloom.sources.tables import Tables

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def fm(spark):
    return feature_matrix(Tables(spark, SF_SMALL)).cache()


def test_auc_of_negated_score(spark, fm):
    a = EV.roc_pr_auc(fm, "F_highly_predictive", "F3924").first()["roc_auc"]
    b = EV.roc_pr_auc(fm.withColumn("neg", -F.col("F_highly_predictive")), "neg", "F3924").first()["roc_auc"]
    assert a == pytest.approx(1 - b, abs=1e-12)
    assert a > 0.9


def test_stratified_folds_partition_rows(spark, fm):
    a = EV.stratified_assign(fm, "F3924", "vec_id", k=5).cache()
    assert a.count() == fm.count()
    per = {(r["F3924"], r["fold"]): r["n"] for r in a.groupBy("F3924", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    for y in (0, 1):
        sizes = [per.get((y, f), 0) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_oversample_equalises_classes(spark, fm):
    bal = MD.random_oversample(fm, "F3924", "vec_id")
    counts = {r["F3924"]: r["n"] for r in bal.groupBy("F3924").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts[0] == counts[1]


def test_mutual_information_ranks_planted_feature_first(spark, fm):
    feats = ["F0", "F1", "F2", "F_highly_predictive", "F34_constant"]
    mi = {r["feature"]: r["mi"] for r in MI.mutual_information(fm, feats, "F3924").collect()}
    assert all(v >= 0 for v in mi.values())
    assert max(mi, key=mi.get) == "F_highly_predictive"


def test_isolation_forest_contamination(spark, fm):
    feats = [f"F{i}" for i in range(8)]
    model = IF.fit(fm, feats, "vec_id", n_trees=50, psi=128, contamination=0.05)
    lab = IF.label(IF.score(fm, model, "vec_id"), model["offset"])
    share = lab.filter(F.col("anomaly_label") == -1).count() / fm.count()
    assert 0.0 < share <= 0.1


def test_tree_shap_additivity(spark, fm):
    from pyspark.ml.functions import vector_to_array

    from riskloom.operators import tree_shap as TS

    feats = [f"F{i}" for i in range(6)] + ["F_highly_predictive"]
    model = MD.fit(fm, feats, "F3924", names=["xgboost"])["xgboost"]
    gbt = model.stages[-1]
    ev = TS.expected_value(TS.extract_trees(gbt))
    sums = TS.explain_trees(fm, gbt, feats, "vec_id").groupBy("vec_id").agg(F.sum("shap").alias("s"))
    raw = model.transform(fm).select("vec_id", vector_to_array("rawPrediction")[1].alias("margin"))
    err = sums.join(raw, "vec_id").agg(F.max(F.abs(F.col("s") + F.lit(ev) - F.col("margin")))).first()[0]
    assert err < 1e-9


def test_smote_knn_is_exact_and_balances(spark, fm):
    import numpy as np

    from riskloom.operators import smote as SM
    feats = [f"F{i}" for i in range(16)]
    pts = fm.filter("F3924 = 1").select(F.col("vec_id").alias("pick"), F.array(*feats).alias("v"))
    n = pts.count()
    near = {m: {(r["i"], r["rank"]): r["dist"] for r in SM.knn_minority(pts, n, 16, 3, m).collect()} for m in ("exact", "projections")}
    rows = sorted((r["pick"], r["v"]) for r in pts.collect())
    X = np.array([v for _, v in rows])
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    for a, (i, _) in enumerate(rows):
        assert np.allclose([near["exact"][i, k] for k in (1, 2, 3)], np.sort(D[a])[:3])
    same = np.mean([abs(near["projections"][p] - d) < 1e-9 for p, d in near["exact"].items()])
    assert same > 0.6 and len(near["projections"]) == len(near["exact"])
    counts = {r["F3924"]: r["count"] for r in SM.smote(fm, feats, "F3924", "vec_id").groupBy("F3924").count().collect()}
    assert counts[0] == counts[1]


def test_exact_neighbours_meet_over_many_blocks(spark, fm, monkeypatch):
    from riskloom.operators import smote as SM

    feats = [f"F{i}" for i in range(4)]
    pts = fm.select(F.col("vec_id").alias("pick"), F.array(*feats).alias("v"))
    n = pts.count()
    want = [(r["i"], r["rank"], r["j"]) for r in SM.knn_minority(pts, n, 4, 3).collect()]
    monkeypatch.setattr(SM, "BLOCK", 16)
    assert sorted(want) == sorted((r["i"], r["rank"], r["j"]) for r in SM.knn_minority(pts, n, 4, 3).collect())


def test_held_out_rows_cannot_change_the_fit(spark, fm):
    from riskloom.operators import models as MD

    a = MD.prepare_training(fm, "F3924", "vec_id", select=False)
    held = {r["vec_id"] for r in a.test.select("vec_id").collect()}
    changed = fm.withColumn("F0", F.when(F.col("vec_id").isin(*held), F.lit(1e9)).otherwise(F.col("F0")))
    b = MD.prepare_training(changed, "F3924", "vec_id", select=False)
    assert a.preprocessor.impute_values == b.preprocessor.impute_values and a.preprocessor.output_columns == b.preprocessor.output_columns
