"""Risk scorecard (P1–P3, R6–R12, R17, W3, E1 in-row).

``score_transactions`` is the flagship dataflow: payload defaulting, feature
resolution, classifier probability, anomaly blend, rule evaluation, override
elevation and key drivers — all one narrow projection, so at any scale it is a
single scan-and-project stage with no shuffle.  Attribution for Column models
is computed in the same row (each feature perturbed to its background mean is
one more expression), which replaces the reference's per-row re-prediction
loop.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.bands import engine_decision, engine_tier, probability_to_score
from ..functions.scalar import clamp, hashed_txn_id, inverted_anomaly_risk, sigmoid, upper_strip
from .column_models import ColumnModel, ProxyModel
from .rules import Rule, default_rules, max_rule, rule_hits


@dataclass
class Background:
    """Feature means and expected probability used for defaults and attribution."""

    means: dict[str, float]
    expected_value: float

    @staticmethod
    def parity(model: ProxyModel) -> "Background":
        means, ev = model.parity_background()
        return Background(means, ev)

    @staticmethod
    def from_frame(df: DataFrame, model: ColumnModel) -> "Background":
        """Column means and mean predicted probability, one aggregate job.

        Only p+1 numbers come back to the driver (fitted state, bounded by the
        feature count, not the row count).
        """
        x = {f: F.col(f"`{f}`").cast("double") for f in model.features}
        aggs = [F.avg(x[f]).alias(f) for f in model.features]
        aggs.append(F.avg(model.probability(x)).alias("__expected__"))
        row = df.agg(*aggs).first().asDict()
        means = {f: (row[f] if row[f] is not None else 0.0) for f in model.features}
        ev = row["__expected__"]
        return Background(means, ev if ev is not None else 0.5)


def normalise_payload(df: DataFrame) -> DataFrame:
    """Defaults of the request model and of the rule evaluator."""
    cols = set(df.columns)

    def opt(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in cols else default

    txn_key = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns if c in ("seq", "sender_id", "receiver_id", "amount", "ts")]) \
        if cols & {"seq", "sender_id", "receiver_id", "amount", "ts"} else F.lit("")
    return df.select(
        "*",
        opt("transaction_id", hashed_txn_id(txn_key)).alias("transaction_id_n"),
        upper_strip(opt("origin_country", F.lit(K.DEFAULT_COUNTRY))).alias("origin_country_n"),
        upper_strip(opt("destination_country", F.lit(K.DEFAULT_COUNTRY))).alias("destination_country_n"),
        opt("amount", F.lit(0.0)).try_cast("double").alias("amount_raw"),
        F.coalesce(opt("account_age_days", F.lit(float(K.DEFAULT_ACCOUNT_AGE_DAYS))).try_cast("double"),
                   F.lit(float(K.DEFAULT_ACCOUNT_AGE_DAYS))).alias("account_age_n"),
        opt("is_international", F.lit(False)).alias("is_international_n"),
    ).withColumn("amount_n", F.coalesce(F.col("amount_raw"), F.lit(0.0))).drop("amount_raw")


def resolve_features(df: DataFrame, features: list[str], means: Mapping[str, float]) -> dict[str, Column]:
    """Custom metric → raw column → background mean, per feature."""
    cols = set(df.columns)
    out = {}
    for f in features:
        cands = []
        if "custom_metrics" in cols:
            cands.append(F.try_element_at(F.col("custom_metrics"), F.lit(f)))
        if f in cols:
            cands.append(F.col(f"`{f}`").try_cast("double"))
        cands.append(F.lit(float(means.get(f, 0.0))))
        out[f] = F.coalesce(*cands) if len(cands) > 1 else cands[0]
    return out


def with_attributions(df: DataFrame, model: ColumnModel, x: Mapping[str, Column], p: Column,
                      background: Background, name: str = "attributions") -> DataFrame:
    """E1 for Column models: ``array<struct<feature, position, value, raw_value>>`` per row.

    marginal_j = p − p(x with x_j ← mean_j); zero attributions when the total
    shift is under 1e-7; rescaled so they sum to the shift when the marginals
    sum above 1e-4; otherwise the shift spread by importance weights.

    For additive-logit models the whole computation is one higher-order
    expression over ``arrays_zip(x, mean, weight, used)`` with the logit sum
    staged as a column, so the expression size does not grow with the
    feature count (a per-feature expression tree would be inlined by the
    optimizer into every consumer and blow past code-generation limits).
    """
    feats = list(model.features)
    n = len(feats)
    imp = model.importance_weights()
    dep = model.depends_on()
    used = [f in background.means and f in dep for f in feats]
    terms = model.logit_terms(x)
    lit_arr = lambda vals, t: F.array(*[F.lit(v).cast(t) for v in vals])
    # Lambdas below read element fields only: per-row scalars travel inside the
    # zipped array (array_repeat is evaluated once per row).  A lambda that
    # referenced an outer column would get that column's whole definition
    # inlined by the optimizer and re-evaluated for every element.
    row_scalars = F.struct(p.alias("p"), (terms[0] if terms is not None else F.lit(0.0)).alias("lsum"))
    zipped = F.arrays_zip(
        F.array(*[x[f].cast("double") for f in feats]).alias("x"),
        lit_arr([float(background.means.get(f, 0.0)) for f in feats], "double").alias("mean"),
        lit_arr([float(terms[2].get(f, 0.0)) if terms is not None else 0.0 for f in feats], "double").alias("w"),
        lit_arr(used, "boolean").alias("used"),
        lit_arr(feats, "string").alias("feature"),
        lit_arr(list(range(n)), "int").alias("position"),
        lit_arr([float(imp.get(f, 1.0 / n)) for f in feats], "double").alias("imp"),
        F.array_repeat(row_scalars, n).alias("r"),
    )
    if terms is not None:
        scale = F.lit(float(terms[1]))
        margs = F.transform(zipped, lambda e: e.withField("m", F.when(
            e["used"], e["r"]["p"] - sigmoid((e["r"]["lsum"] + e["w"] * (e["mean"] - e["x"])) / scale))
            .otherwise(F.lit(0.0))))
    else:
        per = []
        for i, f in enumerate(feats):
            if used[i]:
                perturbed = dict(x)
                perturbed[f] = F.lit(float(background.means[f]))
                per.append(p - model.probability(perturbed))
            else:
                per.append(F.lit(0.0))
        margs = F.transform(F.arrays_zip(zipped.alias("e"), F.array(*per).alias("m")),
                            lambda t: t["e"].withField("m", t["m"]))
    staged = df.select("*", margs.alias("__z"), (p - F.lit(background.expected_value)).alias("__shift"))
    staged = staged.select("*", F.aggregate("__z", F.lit(0.0), lambda acc, e: acc + e["m"]).alias("__total"))
    per_row = F.array_repeat(F.struct(F.col("__shift").alias("shift"), F.col("__total").alias("total")), n)
    attrs = F.transform(F.arrays_zip(F.col("__z").alias("e"), per_row.alias("s")), lambda t: F.struct(
        t["e"]["feature"].alias("feature"), t["e"]["position"].alias("position"),
        F.when(F.abs(t["s"]["shift"]) < F.lit(K.ATTR_ZERO_SHIFT), F.lit(0.0))
        .when(F.abs(t["s"]["total"]) > F.lit(K.ATTR_SCALE_MIN), t["e"]["m"] * (t["s"]["shift"] / t["s"]["total"]))
        .otherwise(t["s"]["shift"] * t["e"]["imp"]).alias("value"),
        t["e"]["x"].alias("raw_value")))
    out = staged.select("*", attrs.alias(name))
    return out.drop("__z", "__shift", "__total")


def key_drivers(attrs: Column) -> Column:
    """Signed value descending (stable), skip |v| < 1e-4, first three."""
    kept = F.filter(attrs, lambda a: F.abs(a["value"]) >= F.lit(K.DRIVER_MIN_ABS))
    keyed = F.transform(kept, lambda a: F.struct((-a["value"]).alias("k"), a["position"].alias("p"),
                                                 a["feature"].alias("feature"), a["value"].alias("value"),
                                                 a["raw_value"].alias("raw_value")))
    ordered = F.sort_array(keyed, asc=True)
    return F.transform(
        F.slice(ordered, 1, K.DRIVER_TOP_N),
        lambda a: F.struct(
            a["feature"].alias("feature"),
            a["value"].alias("importance_attribution"),
            F.when(a["value"] > 0, F.lit("increases_risk")).otherwise(F.lit("reduces_risk")).alias("direction"),
            a["raw_value"].alias("raw_value"),
        ),
    )


def score_transactions(
    df: DataFrame,
    model: ColumnModel | None = None,
    background: Background | None = None,
    bounds: tuple[float, float] | None = (K.ANOMALY_SCORE_MIN, K.ANOMALY_SCORE_MAX),
    rules: list[Rule] | None = None,
    rules_enabled: bool = True,
    with_attribution: bool = True,
) -> DataFrame:
    """R11 batch (and X1 streaming) scorer.

    Optional input columns ``anomaly_score``/``anomaly_label`` (from the
    isolation forest, M6) feed the blend and rule U04; without them anomaly
    risk is 0 while bounds are set, which is the untrained-state behaviour.
    """
    model = model or ProxyModel()
    if background is None:
        background = Background.parity(model) if isinstance(model, ProxyModel) else Background(
            {f: 0.0 for f in model.features}, 0.5)
    rules = default_rules() if rules is None else rules

    n = normalise_payload(df)
    if "anomaly_label" not in n.columns:
        n = n.withColumn("anomaly_label", F.lit(None).cast("int"))
    x = resolve_features(n, model.features, background.means)
    p = F.coalesce(model.probability(x), F.lit(K.PREDICTION_FALLBACK))  # R9

    if bounds is not None and "anomaly_score" in n.columns:
        anomaly_risk = F.coalesce(inverted_anomaly_risk(F.col("anomaly_score"), bounds[0], bounds[1]), F.lit(0.0))
    else:
        anomaly_risk = F.lit(0.0)

    cols = [F.col(c) for c in df.columns if c not in ("anomaly_label",)]
    staged = n.select(
        *cols,
        "transaction_id_n", "origin_country_n", "destination_country_n", "amount_n",
        "account_age_n", "is_international_n", "anomaly_label",
        p.alias("probability"),
        anomaly_risk.alias("anomaly_risk"),
        F.struct(*[x[f].alias(f) for f in model.features]).alias("features"),
    )
    xs = {f: F.col("features")[f] for f in model.features}
    pcol = F.col("probability")
    ml_score = probability_to_score(pcol)
    if bounds is not None:
        blended = clamp(F.lit(K.ML_WEIGHT) * (pcol * F.lit(100.0)) + F.lit(K.ANOMALY_WEIGHT) * F.col("anomaly_risk"),
                        0.0, 100.0)
        blend_score = F.rint(blended).cast("int")
        band_score = probability_to_score(blended / F.lit(100.0))
    else:
        blended = ml_score.cast("double")
        blend_score = ml_score
        band_score = ml_score

    scored = staged.select(
        "*",
        ml_score.alias("ml_score"),
        blended.alias("blended_risk"),
        blend_score.alias("blended_score"),
        engine_tier(band_score).alias("blended_tier"),
        engine_decision(band_score).alias("blended_decision"),
        rule_hits(rules, rules_enabled).alias("rule_hits"),
    )
    top = max_rule(F.col("rule_hits"))
    elevate = top.isNotNull() & (top["trigger_score"] > F.col("blended_score"))
    out = scored.select(
        "*",
        F.size("rule_hits").alias("triggered_rules_count"),
        (F.size("rule_hits") > 0).alias("is_override_applied"),
        F.coalesce(F.col("anomaly_label") == F.lit(-1), F.lit(False)).alias("is_unsupervised_outlier"),
        elevate.alias("is_elevated"),
        F.when(elevate, top["trigger_score"]).otherwise(F.col("blended_score")).alias("final_risk_score"),
        F.when(elevate, top["tier_enforcement"]).otherwise(F.col("blended_tier")).alias("risk_tier"),
        F.when(elevate, top["alert_severity_enforcement"]).otherwise(F.col("blended_tier")).alias("alert_severity"),
        F.when(elevate, engine_decision(probability_to_score(top["trigger_score"] / F.lit(100.0))))
        .otherwise(F.col("blended_decision")).alias("action_decision"),
    )
    if with_attribution:
        out = with_attributions(out, model, xs, pcol, background)
        out = out.withColumn("key_drivers", key_drivers(F.col("attributions")))
    return out


def scorecard_struct(scored: DataFrame, model_name: str = K.PROXY_MODEL_NAME) -> Column:
    """The nested scorecard record."""
    return F.struct(
        F.col("transaction_id_n").alias("transaction_id"),
        F.struct(
            F.lit(K.ENGINE_VERSION).alias("engine_version"),
            F.lit(model_name).alias("selected_model"),
            F.col("is_override_applied"),
            F.col("is_unsupervised_outlier"),
        ).alias("processing_metadata"),
        F.struct(
            F.col("ml_score").alias("base_ml_score"),
            F.col("probability").alias("base_ml_probability"),
            F.col("final_risk_score"),
        ).alias("scores"),
        F.struct(F.col("risk_tier"), F.col("alert_severity"), F.col("action_decision")).alias("categorizations"),
        F.struct(
            F.col("triggered_rules_count"),
            F.transform("rule_hits", lambda h: h.dropFields("neg_position")).alias("overrides"),
        ).alias("rules_audit"),
        F.struct(F.col("key_drivers").alias("key_risk_drivers")).alias("explainability"),
    )


def predict(df: DataFrame, model: ColumnModel, background: Background | None = None) -> DataFrame:
    """Probability and class label at 0.50."""
    background = background or Background({f: 0.0 for f in model.features}, 0.5)
    x = resolve_features(df, model.features, background.means)
    p = F.coalesce(model.probability(x), F.lit(K.PREDICTION_FALLBACK))
    return df.select("*", p.alias("fraud_probability")).withColumn(
        "predicted_class_label", (F.col("fraud_probability") >= F.lit(K.CLASS_THRESHOLD)).cast("int"))
