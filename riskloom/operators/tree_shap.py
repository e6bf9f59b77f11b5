"""Exact path-dependent TreeSHAP for MLlib tree ensembles.

Lundberg, Erion & Lee 2018 (arXiv:1802.03888), Algorithm 2.  The path
structure (features on the path, zero-fractions from node covers) depends on
the tree only, so one traversal per tree serves a whole batch of rows: the
one-fractions and path weights are numpy vectors over the batch.  Rows are
partitioned by Spark and explained in ``mapInPandas``; the ensemble's node
table (trees × nodes, a bound independent of the data) is broadcast.

For gradient-boosted trees the values explain the raw margin
(``Σ weight·leaf``), so Σφ + expected value = margin for every row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def extract_trees(model) -> list[dict]:
    """Node arrays of every tree (feature, threshold, left, right, value, cover) and its weight."""
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0 / model.getNumTrees] * model.getNumTrees
    out = []
    for t, w in zip(model.trees, weights):
        feat, thr, left, right, value, cover = [], [], [], [], [], []

        def walk(node) -> int:
            i = len(feat)
            feat.append(-1)
            thr.append(0.0)
            left.append(-1)
            right.append(-1)
            value.append(float(node.prediction()))
            cover.append(float(node.impurityStats().count()))
            if node.getClass().getSimpleName() == "InternalNode":
                sp = node.split()
                feat[i] = int(sp.featureIndex())
                thr[i] = float(sp.threshold())
                left[i] = walk(node.leftChild())
                right[i] = walk(node.rightChild())
            return i

        walk(t._java_obj.rootNode())
        out.append({"feature": np.array(feat), "threshold": np.array(thr), "left": np.array(left),
                    "right": np.array(right), "value": np.array(value), "cover": np.array(cover), "weight": w})
    return out


def expected_value(trees: list[dict]) -> float:
    """Cover-weighted mean output of the ensemble."""
    total = 0.0
    for tr in trees:
        leaves = tr["feature"] < 0
        total += tr["weight"] * float(np.sum(tr["value"][leaves] * tr["cover"][leaves]) / tr["cover"][0])
    return total


def _extend(path, pz, po, pi):
    l = len(path)
    d, z, o, w = ([p[0] for p in path], [p[1] for p in path], [p[2] for p in path], [p[3].copy() for p in path])
    d.append(pi)
    z.append(pz)
    o.append(po)
    w.append(np.ones_like(po, dtype=float) if l == 0 else np.zeros_like(po, dtype=float))
    for i in range(l - 1, -1, -1):
        w[i + 1] = w[i + 1] + po * w[i] * (i + 1) / (l + 1)
        w[i] = pz * w[i] * (l - i) / (l + 1)
    return [list(t) for t in zip(d, z, o, w)]


def _unwound_sum(path, i):
    """Σ of the path weights after unwinding element i (vector over rows)."""
    l = len(path) - 1
    z_i, o_i = path[i][1], path[i][2]
    n = path[l][3].copy()
    total = np.zeros_like(n)
    hot = o_i != 0
    o_safe = np.where(hot, o_i, 1.0)
    for j in range(l - 1, -1, -1):
        w_hot = n * (l + 1) / ((j + 1) * o_safe)
        w_cold = path[j][3] * (l + 1) / (z_i * (l - j))
        total += np.where(hot, w_hot, w_cold)
        n = np.where(hot, path[j][3] - w_hot * z_i * (l - j) / (l + 1), n)
    return total


def _unwind(path, i):
    l = len(path) - 1
    z_i, o_i = path[i][1], path[i][2]
    hot = o_i != 0
    o_safe = np.where(hot, o_i, 1.0)
    w = [p[3].copy() for p in path]
    n = w[l].copy()
    for j in range(l - 1, -1, -1):
        w_hot = n * (l + 1) / ((j + 1) * o_safe)
        w_cold = w[j] * (l + 1) / (z_i * (l - j))
        new_n = w[j] - w_hot * z_i * (l - j) / (l + 1)
        w[j] = np.where(hot, w_hot, w_cold)
        n = np.where(hot, new_n, n)
    out = [[path[j][0], path[j][1], path[j][2], w[j]] for j in range(l)]
    for j in range(i, l):
        out[j][0], out[j][1], out[j][2] = path[j + 1][0], path[j + 1][1], path[j + 1][2]
    return out


def shap_values(X: np.ndarray, trees: list[dict]) -> np.ndarray:
    """φ for a batch of rows: shape (rows, features)."""
    n, p = X.shape
    phi = np.zeros((n, p))
    for tr in trees:
        feat, thr, left, right = tr["feature"], tr["threshold"], tr["left"], tr["right"]
        value, cover, weight = tr["value"], tr["cover"], tr["weight"]

        def recurse(j, path, pz, po, pi):
            path = _extend(path, pz, po, pi)
            if feat[j] < 0:
                for i in range(1, len(path)):
                    w = _unwound_sum(path, i)
                    phi[:, path[i][0]] += weight * w * (path[i][2] - path[i][1]) * value[j]
                return
            d = feat[j]
            go_left = (X[:, d] <= thr[j]).astype(float)
            iz, io = 1.0, np.ones(n)
            k = next((i for i in range(1, len(path)) if path[i][0] == d), None)
            if k is not None:
                iz, io = path[k][1], path[k][2]
                path = _unwind(path, k)
            recurse(left[j], path, iz * cover[left[j]] / cover[j], io * go_left, d)
            recurse(right[j], path, iz * cover[right[j]] / cover[j], io * (1.0 - go_left), d)

        recurse(0, [], 1.0, np.ones(n), -1)
    return phi


def explain_trees(df: DataFrame, model, features: list[str], id_col: str) -> DataFrame:
    """Long-form ``(id, feature, shap)`` for every row, computed per Arrow batch."""
    spark = df.sparkSession
    trees = extract_trees(model)
    tb = spark.sparkContext.broadcast(trees)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        ts = tb.value
        for pdf in batches:
            X = pdf[features].to_numpy(dtype=float)
            phi = shap_values(X, ts)
            yield pd.DataFrame({
                id_col: np.repeat(pdf[id_col].to_numpy(), len(features)),
                "feature": np.tile(np.array(features, dtype=object), len(pdf)),
                "shap": phi.reshape(-1),
            })

    return df.select(id_col, *features).mapInPandas(run, f"{id_col} {id_type}, feature string, shap double")
