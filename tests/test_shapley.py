import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import shapley as SH
from riskloom.operators.column_models import ColumnModel, LinearModel


class Product(ColumnModel):
    """A model that isn't additive in any scale."""

    features = [f"a{i}" for i in range(6)]

    def probability(self, x):
        return F.abs(x["a0"] * x["a1"]) / (F.lit(1.0) + F.abs(x["a2"] * x["a3"])) + F.when(x["a4"] > x["a5"], F.lit(0.5)).otherwise(F.lit(0.0))


def rows(spark, names, n=20):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.standard_normal((n, len(names))))], ["id", *names])


def test_additions_sum_to_the_difference(spark):
    for model in (Product(), LinearModel([f"a{i}" for i in range(20)], [(-1) ** i * i / 5 for i in range(20)], 0.1)):
        df, background = rows(spark, model.features), {f: 0.3 for f in model.features}
        base = spark.range(1).select(model.probability({f: F.lit(0.3) for f in model.features}).alias("p")).first().p
        want = {r.id: r.p - base for r in df.select("id", model.probability({f: F.col(f) for f in model.features}).alias("p")).collect()}
        got = {r.id: r.s for r in SH.explained(df, model, background, "id", pairs=3).groupBy("id").agg(F.sum("shap").alias("s")).collect()}
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_many_orders_come_near_the_exact_values(spark):
    model = Product()
    df, background = rows(spark, model.features, 5), {f: 0.3 for f in model.features}
    exact = {(r.id, r.feature): r.shap for r in SH.explained(df, model, background, "id").collect()}
    many = {(r.id, r.feature): r.shap for r in SH.explained(df, model, background, "id", pairs=300).collect()}
    assert max(abs(exact[k] - many[k]) for k in exact) < 0.05
