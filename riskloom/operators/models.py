"""Classifiers, balancing and selection loops on MLlib.

Models are ``PipelineModel``s (assembler + classifier) so they save/load with
MLlib's writer (S12) and score with ``transform`` — fully distributed; the
reference's per-row ``predict_proba`` loops disappear.

* M1 logistic regression: L1 (``elasticNetParam=1``), C=0.1 → ``regParam = 1/(C·n)``.
* M2 random forest 100 × depth 8; M3 extra-trees stand-in: the same forest
  without bootstrap and with √p features per split (MLlib has no random
  thresholds; stated in the README).
* M4/M5 gradient-boosted trees in the two reference configurations.
* M7 soft vote: mean of the available members' probabilities (0.12 if none).
* G12 random oversampling with replacement as an equi-join on a drawn index.
* G10 recursive elimination by |coefficient| with cross-validated ROC AUC.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import ensure_checkpoint_dir
from .alerts import hash_fraction
from .column_models import ColumnModel
from . import l1_logistic as L1
from .evaluate import confusion_metrics, roc_pr_auc, roc_pr_auc_by, stratified_assign
from .mutual_info import mutual_information, top_k_features
from .preprocess import GovernancePreprocessor, PreprocessorModel
from .ranking import global_row_number
from .selection import collinear_dropped, collinear_pairs, force_include

CLASS_WEIGHT = "__class_weight"
TASK = 1 << 14  # rows that a task of a fit should at least have
DRAWN_BY_TASK = {"randomforest"}  # MLlib draws these models' rows task by task
MODEL_NAMES = ["xgboost", "lightgbm", "randomforest", "extratrees", "logisticregression"]


def normalise_model_name(name: str, available: list[str]) -> str:
    """Lower-case, strip '_classifier' and spaces; unknown → xgboost → first."""
    n = name.lower().replace("_classifier", "").replace(" ", "").strip()
    if n in available:
        return n
    return "xgboost" if "xgboost" in available else available[0]


def estimators(n_train: int, seed: int = 42) -> dict:
    """M1–M5 on MLlib with the reference hyper-parameters as far as it has them (``random_trees``, ``boosting`` and ``l1_logistic`` have all)."""
    return {
        "logisticregression": LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (0.1 * max(n_train, 1)),
                                                 standardization=False, maxIter=1000),
        "randomforest": RandomForestClassifier(numTrees=100, maxDepth=8, minInstancesPerNode=1, seed=seed),
        "extratrees": RandomForestClassifier(numTrees=100, maxDepth=8, bootstrap=False,
                                             featureSubsetStrategy="sqrt", seed=seed),
        "xgboost": GBTClassifier(maxIter=100, maxDepth=4, stepSize=0.1, seed=seed),
        "lightgbm": GBTClassifier(maxIter=100, maxDepth=5, stepSize=0.1, seed=seed),
        # the alternate pipeline's configuration; rows are weighted by class in fit()
        "xgboost_weighted": GBTClassifier(maxIter=500, maxDepth=5, stepSize=0.03, subsamplingRate=0.8, seed=seed, weightCol=CLASS_WEIGHT),
    }


def in_tasks(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows in tasks of about ``TASK`` rows or more."""
    return df.coalesce(max(1, math.ceil(n / TASK)))


def fit(train: DataFrame, features: list[str], label: str, names: list[str] | None = None) -> dict[str, PipelineModel]:
    """The models ``names`` on ``train``, in tasks of at least ``TASK`` rows: a boosted tree is a job a level, hundreds in all,
    and hundreds of tasks of a few rows each would take nearly all of their time.  Where tasks draw the rows, they stay as they are."""
    n = train.count()
    est = estimators(n)
    train = train.withColumn(CLASS_WEIGHT, F.when(F.col(label) == 1, F.lit(K.POSITIVE_CLASS_WEIGHT)).otherwise(F.lit(1.0)))
    out = {}
    for name in names or MODEL_NAMES:
        e = est[name].setFeaturesCol("features").setLabelCol(label)
        pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), e])
        out[name] = pipe.fit(train if name in DRAWN_BY_TASK else in_tasks(train, n))
    return out


def positive_probability(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """Probability of class 1 as a double column."""
    cols = df.columns
    scored = model.transform(df)
    return scored.select(*cols, vector_to_array("probability")[1].alias(out))


def soft_vote(df: DataFrame, members: dict[str, PipelineModel], out: str = "p_ensemble") -> DataFrame:
    """Mean probability of the members, chained transforms on one frame (no join)."""
    cur = df
    cols = []
    for name, m in members.items():
        cur = positive_probability(m, cur, f"p_{name}")
        cols.append(F.col(f"p_{name}"))
    if not cols:
        return cur.withColumn(out, F.lit(K.PREDICTION_FALLBACK))
    return cur.withColumn(out, reduce(lambda a, b: a + b, cols) / F.lit(float(len(cols))))


def evaluation_record(df: DataFrame, prob: str, label: str, model: str) -> DataFrame:
    """M8: six metrics and the matrix for one model."""
    c = confusion_metrics(df, label, F.col(prob) >= F.lit(K.CLASS_THRESHOLD))
    a = roc_pr_auc(df, prob, label)
    return c.crossJoin(a).select(F.lit(model).alias("model"), "accuracy", "precision", "recall", "f1",
                                 "roc_auc", "pr_auc", "tn", "fp", "fn", "tp")


def anomaly_record(labelled: DataFrame, label: str, model: str = "isolationforest") -> DataFrame:
    """M8: the record of the anomaly model: its -1 rows as class 1; areas are the fixed 0.5 and 0.0, as it gives no probability."""
    c = confusion_metrics(labelled, label, F.col("anomaly_label") == -1)
    return c.select(F.lit(model).alias("model"), "accuracy", "precision", "recall", "f1", F.lit(0.5).alias("roc_auc"), F.lit(0.0).alias("pr_auc"), "tn", "fp", "fn", "tp")


def active_probability(request: str, models: dict[str, ColumnModel], x: dict) -> tuple[str, Column]:
    """The name and probability of the model that ``request`` means; the fallback where there is none or it fails."""
    if not models:
        return "none", F.lit(K.PREDICTION_FALLBACK)
    name = normalise_model_name(request, list(models))
    return name, F.coalesce(models[name].probability(x), F.lit(K.PREDICTION_FALLBACK))


def draws(spark, n: int, size: int, seed: int) -> DataFrame:
    """``n`` rows (draw, pick) with pick in 1..size, from the md5 of the draw's number: the
    same at any partitioning."""
    key = F.concat(F.col("id").cast("string"), F.lit(f"|{seed}"))
    return spark.range(n).select(F.col("id").alias("draw"), (F.floor(hash_fraction(key) * F.lit(size)) + 1).cast("long").alias("pick"))


def numbered_minority(df: DataFrame, label: str, key: str, seed: int = 42) -> tuple[DataFrame, object, int, int]:
    """(minority rows with ``pick`` 1..m in md5 order of the key, its label, m, size of the majority)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return df.limit(0).withColumn("pick", F.lit(0).cast("long")), None, 0, 0
    mino = min(counts, key=lambda c: (counts[c], c))
    n_maj = max(n for c, n in counts.items() if c != mino)
    rows = global_row_number(df.filter(F.col(label) == mino), [F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), F.col(key)], "pick")
    return rows, mino, counts[mino], n_maj


def random_oversample(df: DataFrame, label: str, key: str, seed: int = 42, keep_original: bool = False) -> DataFrame:
    """Draw the minority with replacement up to the majority size.

    Minority rows are numbered 1..m by the hash of ``key`` (distributed numbering); each
    draw's number is hashed to an index and an equi-join on it brings the row (the
    minority side is the small one).  As in the reference the original minority rows are
    replaced unless ``keep_original``.
    """
    minority, mino, n_min, n_maj = numbered_minority(df, label, key, seed)
    if n_min == n_maj:
        return df
    drawn = draws(df.sparkSession, n_maj, n_min, seed).join(minority, "pick").select(*df.columns)
    parts = [df.filter(F.col(label) != mino), drawn]
    if keep_original:
        parts.append(df.filter(F.col(label) == mino))
    return reduce(lambda a, b: a.unionByName(b), parts)


@dataclass
class TrainingData:
    """Training and held-out rows after preprocessing and selection fitted on the former only."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    preprocessor: PreprocessorModel
    dropped_collinear: list[str]


def prepare_training(df: DataFrame, label: str, key: str, test_fraction: float = 0.2, leakage: float = K.TRAINING_LEAKAGE_CORRELATION,
                     top: int = K.TRAINING_MI_TOP, select: bool = True) -> TrainingData:
    """Split, then fit preprocessing, collinearity and mutual information on the training rows.

    Held-out rows pass through the fitted transforms and are seen by none of the fits.
    """
    ensure_checkpoint_dir(df.sparkSession)
    assigned = stratified_assign(df, label, key, test_fraction=test_fraction).checkpoint(eager=True)  # read by every fit below
    rows = {held: assigned.filter(F.col("is_test") == held).select(*df.columns) for held in (False, True)}
    pre = GovernancePreprocessor(max_leakage_correlation=leakage).fit(rows[False], label, exclude=[key])
    train, test = pre.transform(rows[False]), pre.transform(rows[True])
    feats, dropped = list(pre.numeric_features), []
    if select:
        gone = {r["col_j"] for r in collinear_dropped(collinear_pairs(train, feats)).collect()}
        dropped = [f for f in feats if f in gone]
        feats = [f for f in feats if f not in gone]
        best = {r["feature"] for r in top_k_features(mutual_information(train, feats, label), top).collect()}
        feats = force_include([f for f in feats if f in best], pre.numeric_features)
    return TrainingData(train, test, feats, pre, dropped)


def cross_validate(df: DataFrame, features: list[str], label: str, key: str, model: str = "logisticregression", folds: int = 5) -> DataFrame:
    """M9: ``folds`` refits, each scored on the rows it has not seen: (fold, n, roc_auc)."""
    assigned = stratified_assign(df, label, key, k=folds)
    parts = []
    for f in range(folds):
        fitted = fit(assigned.filter(F.col("fold") != f), features, label, names=[model])[model]
        held = positive_probability(fitted, assigned.filter(F.col("fold") == f), "p")
        parts.append(roc_pr_auc(held, "p", label).select(F.lit(f).alias("fold"), (F.col("n_pos") + F.col("n_neg")).alias("n"), "roc_auc"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def elimination_step(remaining: list[str], weight: list[float], n_features: int, step: float, least: int) -> list[str]:
    """What one round of G10 drops: the least weights, ties in column order, at least one and never below ``least``."""
    n = min(max(1, int(math.floor(step * n_features))), len(remaining) - least)
    order = sorted(range(len(remaining)), key=lambda i: (weight[i], i))
    return [remaining[i] for i in order[:max(n, 0)]]


def eliminated_in(features: list[str], weights: dict[str, float], step: float, least: int) -> dict[str, int]:
    """The round, from 1, in which each feature goes if its weight never changes; 0 if it stays."""
    left, out, number = list(features), dict.fromkeys(features, 0), 0
    while len(left) > least:
        number += 1
        for f in elimination_step(left, [weights[f] for f in left], len(features), step, least):
            out[f] = number
            left.remove(f)
    return out


def rfe_cv(df: DataFrame, features: list[str], label: str, key: str, step: float = 0.05, min_features: int = 20,
           folds: int = 3, estimator=None, penalty: float = 10.0) -> list[tuple[str, int, bool]]:
    """Recursive elimination by |LR coefficient|, ROC AUC over stratified folds.

    Returns (feature, ranking, selected).  A round fits the folds and the whole together
    (``l1_logistic``, penalty 1/C), and one pass scores every row by the model that has not
    seen it; what goes next is decided by the fit on all rows.  ``estimator`` is another way to
    fit (Y2): from (rows of x, y, fold; width; folds to leave out, -1 for none) to coefficients,
    a row a model, intercept first.
    """
    estimator = estimator or (lambda rows, width, models: L1.fit_folds(rows, width, penalty, models))
    assigned = stratified_assign(df.select(key, label, *features), label, key, k=folds).select(key, label, "fold", *features).checkpoint(eager=True)
    assigned = in_tasks(assigned, assigned.count())  # read once a step of each round
    remaining, history = list(features), []
    while True:
        models = [*range(folds), -1]
        weights = estimator(L1.training_rows(assigned, remaining, label), len(remaining), models)
        held = F.coalesce(*[F.when(F.col("fold") == m, L1.margin(weights[m], remaining)) for m in range(folds)])
        aucs = [r.roc_auc for r in roc_pr_auc_by(assigned.select("fold", label, held.alias("p")), "p", label, ["fold"]).collect()]
        known = [a for a in aucs if a is not None]
        history.append((list(remaining), sum(known) / len(known) if known else 0.0))
        dropped = elimination_step(remaining, [abs(w) for w in weights[-1][1:]], len(features), step, min_features) if len(remaining) > min_features else []
        if not dropped:
            break
        remaining = [r for r in remaining if r not in dropped]
    best = max(history, key=lambda h: (h[1], -len(h[0])))[0]
    # ranking: 1 for the best subset, then by elimination round (later = better)
    return [(f, 1, True) if f in best else (f, 1 + len(history) - sum(f in subset for subset, _ in history), False) for f in features]
