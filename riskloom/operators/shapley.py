"""Shapley values of any column model (E4, Y3), as expressions of the row alone.

The value of a set of features is the model's probability with the other features at their
background.  ``sampled`` walks hash-drawn orders of the features, each with its reverse
(antithetic), and averages what each feature adds when its turn comes; the additions
of one order always sum to probability minus background probability, so the values do too.
``exact`` weighs all 2^d sets, for up to ``EXACT_FEATURES`` features.  Both evaluate the
model inside array functions: no shuffle, no exploded rows, no Python.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .column_models import ColumnModel

EXACT_FEATURES = 12


def drawn_orders(width: int, pairs: int, seed: int = 42) -> list[list[int]]:
    """2 * ``pairs`` lists of features: each drawn by md5 of seed, draw and feature, and its reverse."""
    out = []
    for r in range(pairs):
        order = sorted(range(width), key=lambda f: hashlib.md5(f"{seed}|{r}|{f}".encode()).hexdigest())
        out += [order, order[::-1]]
    return out


def _numbers(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _mixed(model: ColumnModel, row: Column, background: dict[str, float], present) -> Column:
    """The probability with feature i of the row where ``present(i)``, else of the background."""
    return model.probability({f: F.when(present(i), row[f]).otherwise(F.lit(float(background[f]))) for i, f in enumerate(model.features)})


def _bound(value: Column, body) -> Column:
    """``body`` of a variable: else the optimizer puts the value's definition at each use."""
    return F.transform(F.array(value), body)[0]


def sampled(model: ColumnModel, row: Column, background: dict[str, float], pairs: int = 16, seed: int = 42) -> Column:
    """Array of the features' estimated Shapley values; ``row`` is a struct of the features."""
    d, orders = len(model.features), drawn_orders(len(model.features), pairs, seed)
    place = _numbers([order.index(f) for order in orders for f in range(d)], "int")  # place of each feature in each order

    def walk(row: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(orders) - 1)), lambda o: F.transform(
            F.sequence(F.lit(0), F.lit(d)), lambda n: _mixed(model, row, background, lambda i: F.get(place, o * d + i) < n)))

    def added(values: Column) -> Column:
        def of(f: Column) -> Column:
            def one(total: Column, o: Column) -> Column:
                at = F.get(place, o * d + f)
                return total + F.get(F.get(values, o), at + 1) - F.get(F.get(values, o), at)
            return F.aggregate(F.sequence(F.lit(0), F.lit(len(orders) - 1)), F.lit(0.0), one) / F.lit(float(len(orders)))
        return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), of)

    return _bound(_bound(row, walk), added)


def exact(model: ColumnModel, row: Column, background: dict[str, float]) -> Column:
    """Array of the features' Shapley values over all sets of features."""
    d = len(model.features)
    if d > EXACT_FEATURES:
        raise ValueError(f"{d} features: all sets are for at most {EXACT_FEATURES}; use sampled()")
    weight = _numbers([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)], "double")

    def holds(mask: Column, f) -> Column:
        return F.call_function("shiftright", mask, F.lit(f) if isinstance(f, int) else f).bitwiseAND(1) == 1

    def walk(row: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit((1 << d) - 1)), lambda m: _mixed(model, row, background, lambda i: holds(m, i)))

    def added(values: Column) -> Column:
        def of(f: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1), f)

            def one(total: Column, m: Column) -> Column:
                gain = (F.get(values, m + bit) - F.get(values, m)) * F.get(weight, F.bit_count(m))
                return total + F.when(holds(m, f), F.lit(0.0)).otherwise(gain)
            return F.aggregate(F.sequence(F.lit(0), F.lit((1 << d) - 1)), F.lit(0.0), one)
        return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), of)

    return _bound(_bound(row, walk), added)


def explained(df: DataFrame, model: ColumnModel, background: dict[str, float], key: str, pairs: int | None = None, seed: int = 42) -> DataFrame:
    """(``key``, feature, shap) of every row: over all sets, or over ``pairs`` drawn orders and their reverses."""
    row = F.struct(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float(background[f]))).alias(f) for f in model.features])
    values = exact(model, F.col("row"), background) if pairs is None else sampled(model, F.col("row"), background, pairs, seed)
    names = F.array(*[F.lit(f) for f in model.features])
    return (df.select(key, row.alias("row")).select(key, F.inline(F.arrays_zip(names.alias("feature"), values.alias("shap")))))
