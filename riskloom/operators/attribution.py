"""Attribution and explainability outputs.

Per-row work stays in the row: local attributions are an array column
(``scoring.with_attributions``) and the waterfall is built from it with array
functions, so explaining every row is a narrow projection.  Cross-row
summaries (global importance, beeswarm scales) aggregate the long form by
feature, whose output is bounded by the feature count; only those small
tables are broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .column_models import ColumnModel
from .scoring import Background, resolve_features, with_attributions


def background_from_data(df: DataFrame, model: ColumnModel) -> Background:
    """Means of the resolved features where present, and the mean probability."""
    x = _resolve_nullable(df, model.features)
    aggs = [F.avg(x[f]).alias(f) for f in model.features]
    row = df.agg(*aggs).first().asDict()
    means = {f: (row[f] if row[f] is not None else 0.0) for f in model.features}
    xf = resolve_features(df, model.features, means)
    ev = df.agg(F.avg(model.probability(xf)).alias("ev")).first()["ev"]
    return Background(means, ev if ev is not None else 0.5)


def _resolve_nullable(df: DataFrame, features: list[str]) -> dict[str, Column]:
    cols = set(df.columns)
    out = {}
    for f in features:
        cands = []
        if "custom_metrics" in cols:
            cands.append(F.try_element_at(F.col("custom_metrics"), F.lit(f)))
        if f in cols:
            cands.append(F.col(f"`{f}`").try_cast("double"))
        out[f] = F.coalesce(*cands) if len(cands) > 1 else (cands[0] if cands else F.lit(None).cast("double"))
    return out


def explain(df: DataFrame, model: ColumnModel, background: Background, id_col: str) -> DataFrame:
    """E9 batch explain: id, probability, features struct and attribution array per row."""
    x = resolve_features(df, model.features, background.means)
    staged = df.select(F.col(id_col).alias("row_id"), F.struct(*[x[f].alias(f) for f in model.features]).alias("x"))
    xs = {f: F.col("x")[f] for f in model.features}
    p = model.probability(xs)
    staged = staged.select("*", p.alias("probability"))
    return with_attributions(staged, model, xs, F.col("probability"), background)


def attribution_long(explained: DataFrame) -> DataFrame:
    """Long form ``(row_id, feature, position, value, raw_value)``."""
    # outer form: an inner explode makes the optimizer infer a ``size(array) > 0``
    # filter and push it (with the whole array expression inlined) below the
    # projections; the arrays here are never empty, so outer is equivalent.
    return explained.select("row_id", F.inline_outer("attributions"))


def waterfall(explained: DataFrame, background: Background, top_k: int = K.WATERFALL_TOP_K) -> DataFrame:
    """Base → top-k by |value| → 'Other (n marginal features)' → final, per row.

    Built in-row: sort the attribution array by (-|v|, position), take k,
    sum the rest, running sums over the (≤ k+1) steps, put base and final around them, then
    explode: one pass over the explained rows.
    """
    base = F.lit(float(background.expected_value))
    keyed = F.sort_array(F.transform("attributions", lambda a: F.struct(
        (-F.abs(a["value"])).alias("k"), a["position"].alias("p"), a["feature"].alias("feature"),
        a["value"].alias("value"), a["raw_value"].alias("raw_value"))))
    n = F.size("attributions")
    top = F.slice(keyed, 1, top_k)
    rest = F.when(n > top_k, F.slice(keyed, top_k + 1, F.greatest(n - top_k, F.lit(1))))
    other_sum = F.aggregate(F.coalesce(rest, F.array().cast("array<struct<k:double,p:int,feature:string,value:double,raw_value:double>>")),
                            F.lit(0.0), lambda acc, a: acc + a["value"])
    feat_steps = F.transform(top, lambda a: F.struct(
        a["feature"].alias("feature"), a["value"].alias("value"),
        F.when(a["value"] >= 0, F.lit("positive")).otherwise(F.lit("negative")).alias("type"),
        F.concat(F.lit("Val: "), F.format_string("%.4f", a["raw_value"])).alias("stat_label")))
    other_step = F.when(n > top_k, F.array(F.struct(
        F.concat(F.lit("Other ("), (n - top_k).cast("string"), F.lit(" marginal features)")).alias("feature"),
        other_sum.alias("value"),
        F.when(other_sum >= 0, F.lit("positive")).otherwise(F.lit("negative")).alias("type"),
        F.lit("Aggregate").alias("stat_label")))).otherwise(F.array().cast(
            "array<struct<feature:string,value:double,type:string,stat_label:string>>"))
    staged = explained.select("row_id", "probability", F.concat(feat_steps, other_step).alias("steps0"))
    # running sums in one left fold; the lambdas read only the accumulator and
    # the element, so nothing outer is re-evaluated per element
    step_t = "struct<feature:string,value:double,type:string,stat_label:string,cumulative:double>"
    folded = F.aggregate(
        "steps0",
        F.struct(F.lit(0.0).alias("acc"), F.array().cast(f"array<{step_t}>").alias("out")),
        lambda st, e: F.struct(
            (st["acc"] + e["value"]).alias("acc"),
            F.array_append(st["out"], e.withField("cumulative", base + (st["acc"] + e["value"]))).alias("out")),
        lambda st: st["out"])
    first = F.struct(F.lit(K.BASE_STEP_LABEL).alias("feature"), F.lit(0.0).alias("value"), F.lit("base").alias("type"),
                     F.lit("Global Average").alias("stat_label"), base.alias("cumulative"))
    last = F.struct(F.lit(K.FINAL_STEP_LABEL).alias("feature"), F.lit(0.0).alias("value"), F.lit("total").alias("type"),
                    F.concat(F.format_string("%.2f", F.col("probability") * 100), F.lit("%")).alias("stat_label"),
                    F.col("probability").alias("cumulative"))
    # outer form, as in ``attribution_long``; a row without attributions keeps its two ends
    steps = F.concat(F.array(first), F.coalesce(folded, F.array().cast(f"array<{step_t}>")), F.array(last))
    w = staged.select("row_id", F.posexplode_outer(steps).alias("step", "s"))
    return w.select("row_id", "step", "s.feature", "s.value", "s.cumulative", "s.type", "s.stat_label")


def global_importance(long: DataFrame) -> DataFrame:
    """Mean |attribution| per feature over all rows (output bounded by feature count)."""
    return long.groupBy("feature", "position").agg(F.avg(F.abs("value")).alias("mean_abs_attribution"))


def feature_stats(long: DataFrame) -> DataFrame:
    """A30/A31 in one pass: ``global_importance`` with the least and greatest raw value."""
    return long.groupBy("feature", "position").agg(F.avg(F.abs("value")).alias("mean_abs_attribution"),
                                                   F.min("raw_value").alias("vmin"), F.max("raw_value").alias("vmax"))


def top_features(importance: DataFrame, k: int) -> DataFrame:
    """The k most important features.

    Scores are compared at 12 decimals so that features whose means are equal
    in exact arithmetic (but differ in the last bits from summation order)
    tie, and ties go to feature order.
    """
    return importance.orderBy(F.round("mean_abs_attribution", 12).desc(), F.col("position")).limit(k)


def relative_importance(importance: DataFrame) -> DataFrame:
    """Score / max × 100 (window over the per-feature table only)."""
    return importance.select("*", (F.col("mean_abs_attribution") / F.max("mean_abs_attribution").over(Window.partitionBy())
                                   * F.lit(100.0)).alias("relative_pct"))


def catalog_enrich(importance: DataFrame, drivers: DataFrame | None = None) -> DataFrame:
    """Feature id → friendly name/type, default 'Anonymized Feature <id>'.

    With ``drivers`` (feature, type, shap_value, value: what is known of some features, a row each)
    also shap_value and value; a feature that isn't among them is a 'Model Feature' with its
    importance and '0.00'.
    """
    spark = importance.sparkSession
    cat = spark.createDataFrame(list(K.FEATURE_DESCRIPTIONS.items()), "feature string, name string")
    j = importance.join(F.broadcast(cat), "feature", "left")
    named = j.withColumn("name", F.coalesce(F.col("name"), F.concat(F.lit("Anonymized Feature "), F.col("feature"))))
    if drivers is None:
        return named.withColumn("type", F.lit("Model Feature"))
    known = drivers.select("feature", F.col("type").alias("__t"), F.col("shap_value").alias("__s"), F.col("value").alias("__v"))
    return named.join(known, "feature", "left").select(
        *named.columns, F.coalesce("__t", F.lit("Model Feature")).alias("type"), F.coalesce("__s", "mean_abs_attribution").alias("shap_value"),
        F.coalesce("__v", F.lit("0.00")).alias("value"))


def beeswarm(long: DataFrame, top: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Points of the top features: raw value, 0–1 scaled value, attribution.

    Min/max per feature (A31) is a groupBy bounded by the feature count and is
    broadcast back; every row is kept (no 150-row cap).  ``stats`` (``feature_stats``) spares its pass.
    """
    sel = long.join(F.broadcast(top.select("feature")), "feature")
    if stats is None:
        stats = sel.groupBy("feature").agg(F.min("raw_value").alias("vmin"), F.max("raw_value").alias("vmax"))
    j = sel.join(F.broadcast(stats.select("feature", "vmin", "vmax")), "feature")
    norm = F.when(F.col("vmax") - F.col("vmin") > 0, (F.col("raw_value") - F.col("vmin")) / (F.col("vmax") - F.col("vmin"))) \
        .otherwise(F.lit(0.5))
    return j.select("row_id", "feature", F.col("raw_value").alias("val"), norm.alias("normalized_val"),
                    F.col("value").alias("shap_val"))


def linear_proxy_attribution(df: DataFrame, means: dict[str, float], weights: dict[str, float]) -> DataFrame:
    """(v − mean) · importance for each feature, one projection."""
    return df.select("*", *[((F.col(f"`{f}`") - F.lit(means.get(f, 0.0))) * F.lit(w)).alias(f"attr_{f}")
                            for f, w in weights.items()])
