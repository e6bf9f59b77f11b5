"""Isolation forest (M6, R4, A33, F20) — Liu, Ting & Zhou 2008.

* Sampling: tree t uses the ψ = min(256, n) rows with the smallest md5 of id, tree and seed.
  Each row first keeps only the trees whose hash falls under a threshold sized for
  rather more than 2ψ rows per tree (digests of a batch in numpy — never n×T rows), then a window per tree
  (≈2ψ rows each) keeps the ψ smallest.
* Fitting: the trees grow together, level by level (``random_trees``): one feature that varies
  in the node and a threshold between its ends, both drawn by hash, down to ⌈log2 ψ⌉ levels.
* Scoring: the model is flat node arrays (at most T·4ψ entries) with each leaf's path length,
  walked in numpy over Arrow batches (``flat_trees``).
  score = −2^(−E[h]/c(ψ)); offset = the contamination quantile of the training scores
  (``percentile_approx``); decision = score − offset; label −1 when decision < 0.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import drawn
from ..session import ensure_checkpoint_dir
from .flat_trees import FlatTrees, vector
from .random_trees import grow, leaf_counts

EULER = 0.5772156649015329


def c_factor(n: int) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def sample(df: DataFrame, features: list[str], id_col: str, n: int, n_trees: int, psi: int, seed: int = 42) -> DataFrame:
    """(tree, x) of the ``psi`` rows that each tree is grown on."""
    share = min(1.0, (2.0 * psi + 100.0) / max(n, 1))
    key = lambda t: F.concat_ws("|", F.col(id_col).cast("string"), t.cast("string"), F.lit(str(seed)))
    rows = df.select(F.col(id_col), vector(features).alias("x"))
    if share < 1:  # hash_fraction(key) < share, as numbers
        rows = _drawn(rows, id_col, n_trees, math.ceil(share * (1 << 32)), seed)
    else:
        rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.md5(key(F.col("tree"))), id_col))
    return rows.withColumn("__place", place).where(F.col("__place") <= psi).select("tree", "x")


def _drawn(rows: DataFrame, id_col: str, n_trees: int, limit: int, seed: int) -> DataFrame:
    """(id, x, tree) of the rows whose md5 of id, tree and seed starts with a number below ``limit``."""
    tails = [f"{t}|{seed}".encode() for t in range(n_trees)]
    schema = T.StructType([*rows.schema.fields, T.StructField("tree", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, tree = drawn(b.column(2), tails, limit)
            kept = b.select([0, 1]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tree.astype(np.int32))], schema.names)

    # a null id is left out of the key, with its separator
    return rows.withColumn("__key", F.concat_ws("|", F.col(id_col).cast("string"), F.lit(""))).mapInArrow(run, schema)


def fit(df: DataFrame, features: list[str], id_col: str, n_trees: int = 100, psi: int = 256,
        contamination: float = 0.018, seed: int = 42) -> dict:
    """M6 fit: the trees, ψ, the features and the offset."""
    return fit_scored(df, features, id_col, n_trees, psi, contamination, seed)[0]


def fit_scored(df: DataFrame, features: list[str], id_col: str, n_trees: int = 100, psi: int = 256,
               contamination: float = 0.018, seed: int = 42) -> tuple[dict, DataFrame]:
    """``fit``'s model and the training rows' ``(id, score)``, checkpointed: every row walks the trees once."""
    n = df.count()
    psi = min(psi, n)
    ensure_checkpoint_dir(df.sparkSession)
    members = sample(df, features, id_col, n, n_trees, psi, seed).checkpoint(eager=True)  # ψ·T rows, read at every level
    depth = int(math.ceil(math.log2(max(psi, 2))))
    trees = grow(members, n_trees, depth, candidates=1, min_split=2, seed=seed, by_class=False)
    for r in leaf_counts(members, trees):
        trees.value[trees.at(r.tree, r.node)] = (r.node.bit_length() - 1) + c_factor(r.n)
    model = {"trees": trees, "psi": psi, "features": features, "n_trees": n_trees, "offset": None}
    train_scores = score(df, model, id_col).checkpoint(eager=True)
    offset = train_scores.agg(F.percentile_approx("score", contamination, 100000)).first()[0]
    model["offset"] = None if offset is None else float(offset)
    return model, train_scores


def score(df: DataFrame, model: dict, id_col: str) -> DataFrame:
    """``(id, score)`` with score = −2^(−E[h]/c(ψ)) (higher = more normal)."""
    path = model["trees"].total(vector(model["features"])) / F.lit(float(model["n_trees"]))
    return df.select(id_col, (-F.pow(F.lit(2.0), -path / F.lit(c_factor(model["psi"])))).alias("score"))


def label(scored: DataFrame, offset: float) -> DataFrame:
    """decision = score − offset; anomaly (−1) when decision < 0, else 1."""
    d = F.col("score") - F.lit(offset)
    return scored.select("*", d.alias("decision"), F.when(d < 0, F.lit(-1)).otherwise(F.lit(1)).alias("anomaly_label"))


def bounds(decisions: DataFrame) -> DataFrame:
    """min/max of the training decision scores (one-row table)."""
    return decisions.agg(F.min("decision").alias("anomaly_score_min"), F.max("decision").alias("anomaly_score_max"))


def save(model: dict, spark, path: str) -> None:
    """The model as one text record."""
    record = json.dumps({**model, "trees": model["trees"].to_json()})
    spark.createDataFrame([(record,)], "state string").coalesce(1).write.mode("overwrite").text(path)


def load(spark, path: str) -> dict:
    model = json.loads(spark.read.text(path).first()[0])
    return {**model, "trees": FlatTrees.from_json(model["trees"])}
