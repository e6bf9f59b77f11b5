"""Classifiers that can be written as Column expressions.

A ``ColumnModel`` maps feature Columns to a probability Column, so scoring,
perturbation attribution and evaluation stay one codegen'd projection with no
Python in the row path.  The proxy scorer of the untrained state and a fitted
logistic regression (closed form ``sigmoid(b + w·x)``) are both of this kind;
MLlib tree models go through ``operators.models`` instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalar import sigmoid

# FIXED VALUES — background rows of the untrained (proxy) state: F115 takes
# these values, every other highlighted feature is 0.
PROXY_BACKGROUND_F115 = [-1.0, 0.0, 1.0, -2.0, 2.0]


class ColumnModel:
    features: list[str]
    name: str = "model"

    def probability(self, x: Mapping[str, Column]) -> Column:  # pragma: no cover - protocol
        raise NotImplementedError

    def depends_on(self) -> set[str]:
        """Features the probability actually reads (others perturb to a zero marginal)."""
        return set(self.features)

    def logit_terms(self, x: Mapping[str, Column]) -> tuple[Column, float, dict[str, float]] | None:
        """Additive-logit form ``z = (offset_sum) / scale`` when the model has one.

        Returns ``(sum_column, scale, weights)`` with ``z = sum / scale`` and
        ``sum = b + Σ w_f·x_f``; perturbing feature f to m changes the sum by
        ``w_f·(m − x_f)``, which keeps each perturbed probability an O(1)
        expression over a staged sum.  ``None`` for models without that form.
        """
        return None

    def importance_weights(self) -> dict[str, float]:
        """Uniform unless the model knows better."""
        n = len(self.features)
        return {f: 1.0 / n for f in self.features}


@dataclass
class ProxyModel(ColumnModel):
    """R17 proxy scorer.

    ``mode='f115'``: ``sigmoid(F115)`` when F115 is a feature, else 0.12.
    ``mode='highlighted_mean'``: sigmoid of the mean of the highlighted
    features present, else 0.12.
    """

    features: list[str] = field(default_factory=lambda: list(K.HIGHLIGHTED_FEATURES))
    mode: str = "f115"
    name: str = K.PROXY_MODEL_NAME

    def probability(self, x: Mapping[str, Column]) -> Column:
        if self.mode == "f115":
            if "F115" in self.features:
                return sigmoid(x["F115"])
            return F.lit(K.PREDICTION_FALLBACK)
        present = [f for f in self.features if f in K.HIGHLIGHTED_FEATURES]
        if not present:
            return F.lit(K.PREDICTION_FALLBACK)
        mean = sum((x[f] for f in present[1:]), x[present[0]]) / F.lit(float(len(present)))
        return sigmoid(mean)

    def logit_terms(self, x):
        if self.mode == "f115":
            return (x["F115"], 1.0, {"F115": 1.0}) if "F115" in self.features else None
        present = [f for f in self.features if f in K.HIGHLIGHTED_FEATURES]
        if not present:
            return None
        s = x[present[0]]
        for f in present[1:]:
            s = s + x[f]
        return s, float(len(present)), {f: 1.0 for f in present}

    def depends_on(self) -> set[str]:
        if self.mode == "f115":
            return {"F115"} & set(self.features)
        return {f for f in self.features if f in K.HIGHLIGHTED_FEATURES}

    def parity_background(self) -> tuple[dict[str, float], float]:
        """Background means and expected value of the untrained state."""
        means = {f: 0.0 for f in self.features}
        if "F115" in means:
            means["F115"] = sum(PROXY_BACKGROUND_F115) / len(PROXY_BACKGROUND_F115)
        probs = [1.0 / (1.0 + math.exp(-v)) for v in PROXY_BACKGROUND_F115]
        return means, sum(probs) / len(probs)


@dataclass
class LinearModel(ColumnModel):
    """Logistic model in closed form (M1 after fitting; E4 linear path)."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    name: str = "LogisticRegression"

    def probability(self, x: Mapping[str, Column]) -> Column:
        z = F.lit(float(self.intercept))
        for f, w in zip(self.features, self.coefficients):
            z = z + F.lit(float(w)) * x[f]
        return sigmoid(z)

    def logit_terms(self, x):
        z = F.lit(float(self.intercept))
        for f, w in zip(self.features, self.coefficients):
            z = z + F.lit(float(w)) * x[f]
        return z, 1.0, dict(zip(self.features, [float(w) for w in self.coefficients]))

    def importance_weights(self) -> dict[str, float]:
        a = [abs(w) for w in self.coefficients]
        total = sum(a) if sum(a) > 0 else 1.0
        return {f: w / total for f, w in zip(self.features, a)}
