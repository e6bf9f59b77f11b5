"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the given tables (or frames Spark derives from them) in
full.  Output columns are flat, aliased, integer outputs are bigint and
doubles are rounded to 6 dp so the SQL oracle can compare values.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalar import round6
from ..operators.scoring import score_transactions
from ..sources.fixtures import transactions
from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_transactions(transactions(Tables(spark, sf_dir)))


# ---------------------------------------------------------------- milestone 1


@register("scorecard_rows")
def q_scorecard_rows(spark, sf_dir):
    """One scorecard line per transaction."""
    s = scored(spark, sf_dir)
    return s.select(
        F.col("transaction_id_n").alias("transaction_id"),
        round6("probability").alias("probability"),
        F.col("ml_score").cast("bigint").alias("ml_score"),
        F.col("blended_score").cast("bigint").alias("blended_score"),
        F.col("blended_tier"),
        F.col("final_risk_score").cast("bigint").alias("final_risk_score"),
        F.col("risk_tier"),
        F.col("alert_severity"),
        F.col("action_decision"),
        F.col("triggered_rules_count").cast("bigint").alias("triggered_rules_count"),
        F.array_join(F.transform("rule_hits", lambda h: h["rule_id"]), ",").alias("rule_ids"),
        F.when(F.size("key_drivers") > 0, F.array_join(F.transform("key_drivers", lambda d: d["feature"]), ","))
        .alias("driver_features"),
    )


@register("scorecard_tiers")
def q_scorecard_tiers(spark, sf_dir):
    """Flagship: final tier / decision counts after rules, with alert counts."""
    s = scored(spark, sf_dir)
    return s.groupBy("risk_tier", "action_decision").agg(
        F.count(F.lit(1)).alias("n_transactions"),
        F.count_if(F.col("final_risk_score") > 25).alias("n_alerts"),
        F.count_if(F.col("is_elevated")).alias("n_elevated"),
        round6(F.avg("probability")).alias("avg_probability"),
    )


@register("blended_tiers")
def q_blended_tiers(spark, sf_dir):
    """R7 before rules: tier counts of the blended score."""
    s = scored(spark, sf_dir)
    return s.groupBy("blended_tier").agg(F.count(F.lit(1)).alias("n_transactions"),
                                         F.min("blended_score").cast("bigint").alias("min_score"),
                                         F.max("blended_score").cast("bigint").alias("max_score"))


@register("rule_hit_counts")
def q_rule_hit_counts(spark, sf_dir):
    """Hits per rule and how often each rule elevated the score."""
    s = scored(spark, sf_dir)
    hits = s.select(F.explode_outer("rule_hits").alias("h"), "blended_score").filter(F.col("h").isNotNull())
    return hits.groupBy(F.col("h.rule_id").alias("rule_id")).agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.count_if(F.col("h.trigger_score") > F.col("blended_score")).alias("n_above_model"),
    )


# ---------------------------------------------------------------- milestone 2

from ..operators import alerts as AL  # noqa: E402
from ..operators import analytics as AN  # noqa: E402
from ..sources.fixtures import alert_updates, ingest_requests  # noqa: E402


def alert_store(spark, sf_dir):
    return AL.materialize_alerts(scored(spark, sf_dir))


def workflow(spark, sf_dir):
    from ..session import ensure_checkpoint_dir

    alerts, logs = alert_store(spark, sf_dir)
    # four consumers (routing, initial state, final state, logs) read the alert
    # table: materialise it once in the shared checkpoint folder (lineage cut,
    # survives executor loss, not shared with other queries like a cache)
    ensure_checkpoint_dir(spark)
    alerts = alerts.checkpoint(eager=True)
    logs = AL.opening_logs(alerts)
    routed, rejected = AL.route_updates(alert_updates(Tables(spark, sf_dir)), alerts)
    valid, invalid = AL.validate_status(routed)
    # the routed updates feed three consumers (final state, local scan,
    # bucket summary): materialise once instead of re-scanning and re-joining
    valid = valid.checkpoint(eager=True)
    after, update_logs = AL.apply_updates(alerts, valid)
    why = rejected.withColumn("reason", F.lit("unknown account")).unionByName(
        invalid.select(*rejected.columns).withColumn("reason", F.lit("invalid status")))
    return alerts, logs, after, update_logs, why


def _alert_out(a):
    return a.select("id", "transaction_id", "sender_id", "receiver_id", round6("amount").alias("amount"),
                    F.col("risk_score").cast("bigint").alias("risk_score"), "risk_tier", "severity", "status",
                    "reason", "timestamp", "assigned_to")


@register("alerts_materialized")
def q_alerts_materialized(spark, sf_dir):
    """Alerts created from the scored batch."""
    alerts, _ = alert_store(spark, sf_dir)
    return _alert_out(alerts)


@register("alert_telemetry")
def q_alert_telemetry(spark, sf_dir):
    """A1–A4 dashboard telemetry after the workflow updates."""
    _, _, after, _, _ = workflow(spark, sf_dir)
    t = AN.telemetry(after)
    return t.select(*[round6(c).alias(c) if c == "average_risk_rating" else F.col(c) for c in t.columns])


@register("alert_workflow_state")
def q_alert_workflow_state(spark, sf_dir):
    """Alert status and assignee after the ordered updates."""
    alerts, logs, after, update_logs, _ = workflow(spark, sf_dir)
    n_logs = logs.unionByName(update_logs).groupBy("alert_key").agg(F.count(F.lit(1)).alias("n_logs"))
    return after.join(n_logs, "alert_key", "left").select(
        "id", "status", "assigned_to", F.col("n_updates").cast("bigint").alias("n_updates"),
        F.coalesce(F.col("n_logs"), F.lit(0)).cast("bigint").alias("n_logs"))


@register("alert_workflow_logs")
def q_alert_workflow_logs(spark, sf_dir):
    """The audit-log rows the updates append, in long form."""
    _, _, _, update_logs, _ = workflow(spark, sf_dir)
    return update_logs.select("alert_id", "log_seq", "operator", "action", "timestamp")


@register("update_rejections")
def q_update_rejections(spark, sf_dir):
    """Updates whose account has no alert (the 404 set) or whose status isn't known."""
    _, _, _, _, rejected = workflow(spark, sf_dir)
    return rejected.groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("n_rejected"))


@register("alert_view")
def q_alert_view(spark, sf_dir):
    """Analyst projection (type classifier, confidence, priority)."""
    _, _, after, _, _ = workflow(spark, sf_dir)
    v = AN.alert_view(after)
    return v.select("id", "account_number", "type", F.col("risk_score").cast("bigint").alias("risk_score"),
                    "confidence", F.col("confidence_val").cast("bigint").alias("confidence_val"), "status",
                    "holder_name", round6("balance").alias("balance"), round6("ytd_inflows").alias("ytd_inflows"),
                    "prio", "assigned_to")


@register("dashboard_kpis")
def q_dashboard_kpis(spark, sf_dir):
    """risk/category distribution, exposure, KPI counts."""
    _, _, after, _, _ = workflow(spark, sf_dir)
    k = AN.dashboard_kpis(AN.alert_view(after))
    money = ("total_risk_amount", "total_target_amount")
    return k.select(*[F.round(c, 2).alias(c) if c in money else round6(c).alias(c) if c in ("mean_confidence",
                      "mitigation_rate") else F.col(c).cast("bigint").alias(c) for c in k.columns])


@register("queue_counts")
def q_queue_counts(spark, sf_dir):
    """Per-status tab counts and All (ROLLUP)."""
    _, _, after, _, _ = workflow(spark, sf_dir)
    return AN.queue_counts(AN.alert_view(after))


@register("alert_list_open_critical")
def q_alert_list(spark, sf_dir):
    """GET /alerts?status=open&severity=critical (limit 1000)."""
    _, _, after, _, _ = workflow(spark, sf_dir)
    lst = AL.list_alerts(after, status="open", severity="critical", limit=1000)
    return lst.select("id", F.col("risk_score").cast("bigint").alias("risk_score"), "status", "severity",
                      F.col("queue_position").cast("bigint").alias("queue_position"), "alerts_count")


@register("critical_recent")
def q_critical_recent(spark, sf_dir):
    """The three newest alerts scoring above 80."""
    alerts, _ = alert_store(spark, sf_dir)
    return AL.critical_recent(alerts).select("id", F.col("risk_score").cast("bigint").alias("risk_score"), "seq")


@register("explorer_page")
def q_explorer_page(spark, sf_dir):
    """Explorer search 'acc-1', band 90+, page 2 of 5 rows."""
    _, _, after, _, _ = workflow(spark, sf_dir)
    v = AN.band_filter(AN.search(AN.alert_view(after), "acc-1", ["id", "account_number", "holder_name"]), "90+")
    p = AL.page(v, [F.col("risk_score").desc(), F.col("id")], 2)
    return p.select("id", "account_number", F.col("risk_score").cast("bigint").alias("risk_score"),
                    F.col("showing_from").cast("bigint").alias("showing_from"),
                    F.col("showing_to").cast("bigint").alias("showing_to"),
                    F.col("showing_of").cast("bigint").alias("showing_of"),
                    F.col("n_pages").cast("bigint").alias("n_pages"))


@register("outlier_points")
def q_outlier_points(spark, sf_dir):
    """Outlier table rows and scatter coordinates."""
    _, _, after, _, _ = workflow(spark, sf_dir)
    o = AN.outlier_points(AN.alert_view(after))
    return o.select("id", "account_number", F.col("risk_score").cast("bigint").alias("risk_score"),
                    round6("x").alias("x"), round6("y").alias("y"), "label")


@register("case_narratives")
def q_case_narratives(spark, sf_dir):
    """Per-alert narrative, indicator and confidence text."""
    _, _, after, _, _ = workflow(spark, sf_dir)
    return AN.case_narrative(AN.alert_view(after))


@register("alert_backfill")
def q_alert_backfill(spark, sf_dir):
    """Backfill alerts from the scored-batch rows."""
    batch = AL.batch_risk_scores(scored(spark, sf_dir))
    alerts, logs = AL.backfill_alerts(batch)
    n_logs = logs.groupBy(F.col("alert_key").alias("id")).agg(F.count(F.lit(1)).alias("n_logs"))
    return _alert_out(alerts).join(n_logs, "id") \
        .withColumn("n_logs", F.col("n_logs").cast("bigint"))


@register("backfill_sample")
def q_backfill_sample(spark, sf_dir):
    """A quarter of the scored batch by the hash of its key, counted by band."""
    s = AL.sample_rows(scored(spark, sf_dir), 0.25)
    return s.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").cast("bigint").alias("sum_seq"))


@register("alert_ingest")
def q_alert_ingest(spark, sf_dir):
    """Manual ingest with derived tier/severity and status validation."""
    alerts, _, rejected = AL.ingest_alerts(ingest_requests(Tables(spark, sf_dir)))
    acc = alerts.groupBy("status", "risk_tier", "severity").agg(F.count(F.lit(1)).alias("n_alerts"))
    rej = rejected.groupBy(F.lit("REJECTED").alias("status")).agg(F.count(F.lit(1)).alias("n_alerts")) \
        .select("status", F.lit(None).cast("string").alias("risk_tier"), F.lit(None).cast("string").alias("severity"),
                "n_alerts")
    return acc.unionByName(rej)


@register("rule_exception_kpis")
def q_rule_exception_kpis(spark, sf_dir):
    """A5/A6 re-aimed: share of scored rows with a rule hit; alert precision vs label."""
    s = scored(spark, sf_dir)
    alert = F.col("final_risk_score") > F.lit(25)
    y = F.col("F3924") == 1
    r = s.agg(
        F.avg((F.size("rule_hits") > 0).cast("double")).alias("rule_exception_rate"),
        F.count_if(alert & y).alias("tp"), F.count_if(alert & ~y).alias("fp"),
    )
    return r.select(round6("rule_exception_rate").alias("rule_exception_rate"), "tp", "fp",
                    round6(F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)))
                    .alias("classification_precision"))


@register("weekday_trend")
def q_weekday_trend(spark, sf_dir):
    """A35 re-aimed: transactions per weekday with the spike flag."""
    return AN.weekday_trend(transactions(Tables(spark, sf_dir))).select(
        F.col("dow").cast("bigint").alias("dow"), "day", "n", "is_spike")


@register("notes_merge")
def q_notes_merge(spark, sf_dir):
    """Local notes (error events) merged with log notes, deduped on content."""
    alerts, logs, after, update_logs, _ = workflow(spark, sf_dir)
    routed, _ = AL.route_updates(alert_updates(Tables(spark, sf_dir)), alerts)
    local = routed.filter(F.col("event_type") == "error").select(
        "alert_key", "alert_id", F.lit("Analyst (local)").alias("author"), AL.clock_utc("ts").alias("timestamp"),
        F.col("notes").alias("content"))
    m = AN.merge_notes(local, update_logs)
    return m.groupBy("alert_key").agg(F.first("alert_id").alias("alert_id"), F.count(F.lit(1)).alias("n_notes"),
                                      F.count_if(F.col("log_seq") >= 0).alias("n_from_log")).drop("alert_key")


# ---------------------------------------------------------------- milestone 3

from ..operators import profiling as PR  # noqa: E402
from ..operators import selection as SE  # noqa: E402
from ..operators.preprocess import GovernancePreprocessor, PreprocessorModel  # noqa: E402
from ..sources.fixtures import feature_matrix  # noqa: E402
from ..sources.tables import split_columns  # noqa: E402

TARGET = "F3924"


def features(spark, sf_dir):
    return feature_matrix(Tables(spark, sf_dir))


def feature_columns(df):
    return [c for c in df.columns if c not in ("vec_id", TARGET)]


def collinear_columns(df):
    num, _ = split_columns(df.select(*feature_columns(df)))
    return num


@register("missing_profile")
def q_missing_profile(spark, sf_dir):
    """Missing count, fraction and dtype per feature column."""
    fm = features(spark, sf_dir)
    p = PR.missing_profile(fm, feature_columns(fm))
    return p.select("feature", F.col("missing_count").cast("bigint").alias("missing_count"),
                    round6("missing_percentage").alias("missing_percentage"), "dtype",
                    F.col("missing_rank").cast("bigint").alias("missing_rank"))


@register("numeric_profile")
def q_numeric_profile(spark, sf_dir):
    """var_pop, mean, min, max, median, guarded target correlation."""
    fm = features(spark, sf_dir)
    num, _ = split_columns(fm.select(*feature_columns(fm)))
    p = PR.numeric_profile(fm, num, TARGET)
    return p.select("feature", F.col("n").cast("bigint").alias("n"),
                    *[round6(c).alias(c) for c in ("var_pop", "mean", "min", "max", "median", "corr_target")])


@register("categorical_profile")
def q_categorical_profile(spark, sf_dir):
    """Distinct ≤ 1 test and deterministic mode per text column."""
    fm = features(spark, sf_dir)
    _, cat = split_columns(fm.select(*feature_columns(fm)))
    p = PR.categorical_profile(fm, cat)
    return p.select("feature", F.col("n").cast("bigint").alias("n"), "n_distinct_le1", "mode")


@register("separator_test")
def q_separator_test(spark, sf_dir):
    """Deterministic categorical separators of the target."""
    fm = features(spark, sf_dir)
    _, cat = split_columns(fm.select(*feature_columns(fm)))
    return PR.separator_test(fm, cat, TARGET)


@register("leakage_audit")
def q_leakage_audit(spark, sf_dir):
    """Name-overlap, high-correlation and separator findings."""
    fm = features(spark, sf_dir).drop("vec_id")
    a = PR.leakage_audit(fm, TARGET)
    return a.select("feature", "rule", round6("value").alias("value"), "reason")


@register("preprocess_report")
def q_preprocess_report(spark, sf_dir):
    """Decision per column and the fitted fill value."""
    fm = features(spark, sf_dir)
    model = GovernancePreprocessor().fit(fm, TARGET, exclude=["vec_id"])
    r = model.report(spark)
    return r.select("feature", F.col("position").cast("bigint").alias("position"), "decision", "reason",
                    F.when(F.col("decision") == "kept", F.col("impute_value")).alias("impute_value_raw")) \
        .withColumn("impute_numeric", round6(F.col("impute_value_raw").try_cast("double"))) \
        .withColumn("impute_text", F.when(F.col("impute_value_raw").try_cast("double").isNull(), F.col("impute_value_raw"))) \
        .drop("impute_value_raw")


@register("preprocessed_matrix")
def q_preprocessed_matrix(spark, sf_dir):
    """P4/G7 transform: fitted columns, imputed, per row (numeric rounded)."""
    fm = features(spark, sf_dir)
    model = GovernancePreprocessor().fit(fm, TARGET, exclude=["vec_id"])
    return _matrix_rows(model.transform(fm))


def _matrix_rows(out):
    """A preprocessed matrix in long form: value_numeric or value_text of each row and column."""
    kinds = {f.name: f.dataType.simpleString() for f in out.schema if f.name not in ("vec_id", TARGET)}
    return out.select("vec_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 (round6(PR.q(c)) if kind == "double" else F.lit(None).cast("double")).alias("value_numeric"),
                 (PR.q(c) if kind == "string" else F.lit(None).cast("string")).alias("value_text"))
        for c, kind in kinds.items()])))


@register("collinear_pairs")
def q_collinear_pairs(spark, sf_dir):
    """Upper-triangle pairs above 0.95 |Pearson|."""
    fm = features(spark, sf_dir)
    p = SE.collinear_pairs(fm, collinear_columns(fm))
    return p.select("col_i", "col_j", round6("abs_corr").alias("abs_corr"))


# ---------------------------------------------------------------- milestone 4

from ..operators import evaluate as EV  # noqa: E402


def scored_labels(spark, sf_dir):
    return scored(spark, sf_dir).select("seq", "probability", F.col(TARGET).alias("y"))


@register("class_distribution")
def q_class_distribution(spark, sf_dir):
    """Class counts and fractions of the transaction label."""
    d = EV.class_distribution(scored_labels(spark, sf_dir), "y")
    return d.select(F.col("label").cast("bigint").alias("label"), "n", round6("fraction").alias("fraction"))


@register("confusion_metrics")
def q_confusion_metrics(spark, sf_dir):
    """Confusion matrix and derived rates at p ≥ 0.5."""
    c = EV.confusion_metrics(scored_labels(spark, sf_dir), "y", EV.predicted_label("probability"))
    return c.select("tn", "fp", "fn", "tp", *[round6(x).alias(x) for x in (
        "accuracy", "precision", "recall", "f1", "fpr_pct", "tnr_pct", "tpr_pct", "fnr_pct")])


@register("roc_pr_auc")
def q_roc_pr_auc(spark, sf_dir):
    """Tie-aware ROC AUC and step-wise average precision."""
    r = EV.roc_pr_auc(scored_labels(spark, sf_dir), "probability", "y")
    return r.select("n_pos", "n_neg", round6("roc_auc").alias("roc_auc"), round6("pr_auc").alias("pr_auc"))


@register("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    """5 stratified folds and a 20 % stratified hold-out."""
    a = EV.stratified_assign(scored_labels(spark, sf_dir), "y", "seq", k=5, test_fraction=0.2)
    return a.groupBy(F.col("fold").cast("bigint").alias("fold"), F.col("y").cast("bigint").alias("label"), "is_test") \
        .agg(F.count(F.lit(1)).alias("n"))


@register("cv_summary")
def q_cv_summary(spark, sf_dir):
    """Mean and population std of per-fold ROC AUC."""
    a = EV.stratified_assign(scored_labels(spark, sf_dir), "y", "seq", k=5)
    s = EV.cv_summary(a, "probability", "y", 5)
    return s.select(round6("cv_auc_mean").alias("cv_auc_mean"), round6("cv_auc_std").alias("cv_auc_std"), "n_folds")


# ---------------------------------------------------------------- milestone 5

from ..operators import attribution as AT  # noqa: E402
from ..operators.column_models import LinearModel, ProxyModel  # noqa: E402


def _z(c):
    """Round to 6 dp and turn -0.0 into 0.0 (same on the SQL side)."""
    return round6(c) + F.lit(0.0)


def explained(spark, sf_dir):
    txn = transactions(Tables(spark, sf_dir))
    model = ProxyModel(mode="highlighted_mean")
    ensure_checkpoint_dir(spark)
    # the means, the mean probability and the rows themselves: the joins behind the transactions run once
    txn = txn.select("transaction_id", "custom_metrics", *[c for c in txn.columns if c in model.features]).checkpoint(eager=True)
    bg = AT.background_from_data(txn, model)
    return AT.explain(txn, model, bg, "transaction_id"), bg


@register("local_attributions")
def q_local_attributions(spark, sf_dir):
    """Perturbation attributions per transaction and feature (long form)."""
    ex, _ = explained(spark, sf_dir)
    return AT.attribution_long(ex).select("row_id", "feature", _z("value").alias("value"),
                                          _z("raw_value").alias("raw_value"))


@register("wide_attributions")
def q_wide_attributions(spark, sf_dir):
    """E1/E4/Y3 on a wide linear model: 64 dimensions and their 6 sums of ten, mean |attribution| by feature."""
    fm = features(spark, sf_dir)
    dims = [f"F{i}" for i in range(64)]
    sums = [sum((F.col(f"F{10 * g + i}") for i in range(1, 10)), F.col(f"F{10 * g}")).alias(f"S{g}") for g in range(6)]
    wide = fm.select("vec_id", *dims, *sums)
    names = [*dims, *[f"S{g}" for g in range(6)]]
    model = LinearModel(names, [((i * 7) % 11 - 5) / 10.0 for i in range(len(names))], -0.5)
    ex = AT.explain(wide, model, AT.background_from_data(wide, model), "vec_id")
    imp = AT.global_importance(AT.attribution_long(ex))
    return imp.select("feature", F.col("position").cast("bigint").alias("position"), _z("mean_abs_attribution").alias("mean_abs_attribution"))


@register("waterfall_steps")
def q_waterfall_steps(spark, sf_dir):
    """Base, top-8 steps, Other bucket and final probability per row."""
    ex, bg = explained(spark, sf_dir)
    w = AT.waterfall(ex, bg)
    return w.select("row_id", F.col("step").cast("bigint").alias("step"), "feature", _z("value").alias("value"),
                    _z("cumulative").alias("cumulative"), "type")


@register("global_importance")
def q_global_importance(spark, sf_dir):
    """Top-15 mean |attribution| with catalog names and relative %."""
    ex, _ = explained(spark, sf_dir)
    imp = AT.global_importance(AT.attribution_long(ex))
    top = AT.relative_importance(AT.catalog_enrich(AT.top_features(imp, 15)))
    return top.select("feature", _z("mean_abs_attribution").alias("mean_abs_attribution"), "name", "type",
                      _z("relative_pct").alias("relative_pct"))


@register("beeswarm_points")
def q_beeswarm_points(spark, sf_dir):
    """Top-10 features × every row: value, 0–1 scale, attribution."""
    ex, _ = explained(spark, sf_dir)
    long = AT.attribution_long(ex)
    stats = AT.feature_stats(long).checkpoint(eager=True)  # a row a feature
    b = AT.beeswarm(long, AT.top_features(stats, 10), stats)
    return b.select("row_id", "feature", _z("val").alias("val"), _z("normalized_val").alias("normalized_val"),
                    _z("shap_val").alias("shap_val"))


# ---------------------------------------------------------------- milestone 6

from ..operators import mutual_info as MI  # noqa: E402


def mi_features(fm):
    num, _ = split_columns(fm.select(*feature_columns(fm)))
    return num


@register("mutual_information")
def q_mutual_information(spark, sf_dir):
    """k=3 nearest-neighbour mutual information of every numeric feature with the target."""
    fm = features(spark, sf_dir)
    mi = MI.mutual_information(fm, mi_features(fm), TARGET)
    return mi.select("feature", "n", round6("mi").alias("mi"), round6("mi_raw").alias("mi_raw"))


@register("mi_top_features")
def q_mi_top_features(spark, sf_dir):
    """The 40 highest-MI features (ties in column order) with their rank."""
    fm = features(spark, sf_dir)
    mi = MI.mutual_information(fm, mi_features(fm), TARGET)
    top = MI.top_k_features(mi, 40)
    return top.select("feature", F.col("position").cast("bigint").alias("position"),
                      F.col("mi_rank").cast("bigint").alias("mi_rank"), round6("mi").alias("mi"))


# ---------------------------------------------------------------- milestone 9 (streaming)

from ..session import ensure_checkpoint_dir, scratch_path  # noqa: E402
from ..streaming import scorecard_stream as ST  # noqa: E402


# the staged files hold a year each, so requests come up to a year late
YEARLY_FILES = "400 days"


@register("stream_alerts")
def q_stream_alerts(spark, sf_dir):
    """Transactions replayed as a file stream (with duplicates), scored,
    deduplicated and sunk as alerts; must equal the batch alerts."""
    txn = transactions(Tables(spark, sf_dir))
    src = scratch_path(spark, "txn-stream-src")
    sink = scratch_path(spark, "alert-stream-sink")
    ST.stage_transactions(txn, src)
    schema = spark.read.parquet(src).schema
    ST.run_alert_stream(spark, src, schema, sink, delay=YEARLY_FILES)
    a = spark.read.parquet(sink)
    return a.groupBy("risk_tier", "severity").agg(F.count(F.lit(1)).alias("n_alerts"),
                                                 F.countDistinct("transaction_id").alias("n_transactions"),
                                                 F.sum("risk_score").cast("bigint").alias("sum_score"))


@register("stream_telemetry")
def q_stream_telemetry(spark, sf_dir):
    """30-day event-time windows × tier counts from the stream."""
    txn = transactions(Tables(spark, sf_dir))
    src = scratch_path(spark, "txn-tele-src")
    out = scratch_path(spark, "telemetry-out")
    ST.stage_transactions(txn, src, replay_year=None)
    schema = spark.read.parquet(src).schema
    ST.run_telemetry_stream(spark, src, schema, out, delay=YEARLY_FILES)
    t = ST.read_telemetry(spark, out)
    # window start rendered in UTC regardless of the session time zone
    start = F.date_format(F.to_utc_timestamp("w.start", spark.conf.get("spark.sql.session.timeZone")), "yyyy-MM-dd")
    return t.select(start.alias("window_start"), "risk_tier", "n",
                    round6("avg_score").alias("avg_score"))


# ---------------------------------------------------------------- milestone 7 (models)

from ..operators import models as MD  # noqa: E402


def training_frame(spark, sf_dir, **options):
    """Split first; preprocessing (and selection) fitted on the training rows only."""
    return MD.prepare_training(features(spark, sf_dir), TARGET, "vec_id", **options)


def whole_frame(spark, sf_dir):
    """Every row through the preprocessor that was fitted on the training rows."""
    d = training_frame(spark, sf_dir, select=False)
    return d.preprocessor.transform(features(spark, sf_dir)), d.preprocessor.numeric_features


@register("training_split")
def q_training_split(spark, sf_dir):
    """Held-out sizes and the medians that the preprocessor takes from training rows alone."""
    d = training_frame(spark, sf_dir, select=False)
    n = {r[0]: r[1] for r in d.train.groupBy(F.col(TARGET)).count().collect()}
    held = {r[0]: r[1] for r in d.test.groupBy(F.col(TARGET)).count().collect()}
    fills = [(f, float(d.preprocessor.impute_values[f])) for f in d.preprocessor.numeric_features]
    return spark.createDataFrame(fills, "feature string, v double").select(
        "feature", round6("v").alias("median"), *[F.lit(c.get(y, 0)).cast("bigint").alias(f"n_{k}_{y}") for k, c in (("train", n), ("test", held)) for y in (0, 1)])


@register("model_metrics")
def q_model_metrics(spark, sf_dir):
    """Split, fit on the training rows, select, balance, train, evaluate on the held-out 20 %."""
    d = training_frame(spark, sf_dir)
    ensure_checkpoint_dir(spark)
    train = MD.random_oversample(d.train, TARGET, "vec_id").checkpoint(eager=True)
    test = d.test.checkpoint(eager=True)
    models = MD.fit(train, d.features, TARGET)
    recs = []
    for name, m in models.items():
        recs.append(MD.evaluation_record(MD.positive_probability(m, test, "p"), "p", TARGET, name))
    ens = MD.soft_vote(test, {k: models[k] for k in ("xgboost", "lightgbm", "randomforest")})
    recs.append(MD.evaluation_record(ens, "p_ensemble", TARGET, "ensemble"))
    from functools import reduce as _r

    out = _r(lambda x, y: x.unionByName(y), recs)
    return out.select("model", *[round6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")],
                      "tn", "fp", "fn", "tp")


@register("cross_validation")
def q_cross_validation(spark, sf_dir):
    """M9: five refits of the logistic model, each scored on its held-out fold."""
    d = training_frame(spark, sf_dir)
    cv = MD.cross_validate(d.train, d.features, TARGET, "vec_id")
    return cv.select(F.col("fold").cast("bigint").alias("fold"), "n", round6("roc_auc").alias("roc_auc"))


@register("oversampled_classes")
def q_oversampled_classes(spark, sf_dir):
    """How often random oversampling takes each row (equal classes)."""
    bal = MD.random_oversample(features(spark, sf_dir), TARGET, "vec_id")
    return bal.groupBy("vec_id", F.col(TARGET).cast("bigint").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("rfe_selection")
def q_rfe_selection(spark, sf_dir):
    """G8→G9→G10 (G11) + U4: drop collinear columns, MI top-40 pre-prune, RFE-CV with
    L1 logistic regression, then append categorical columns and forced features."""
    d = training_frame(spark, sf_dir)
    data, feats_all, dropped = d.train, d.preprocessor.numeric_features, d.dropped_collinear
    ranking = MD.rfe_cv(data, d.features, TARGET, "vec_id", step=K.RFE_STEP, min_features=K.RFE_MIN_FEATURES, folds=3)
    rows = [(f, r, s) for f, r, s in ranking]
    _, cats = split_columns(data.select(*[c for c in data.columns if c not in ("vec_id", TARGET)]))
    selected = SE.force_include([f for f, _, s in rows if s] + cats, feats_all)
    rows = [(f, r, f in selected) for f, r, _ in rows] + [(c, 1, True) for c in cats] \
        + [(c, 0, False) for c in sorted(dropped)]
    return spark.createDataFrame(rows, "feature string, ranking int, selected boolean")


# ---------------------------------------------------------------- milestone 8 (anomaly)

from ..operators import isolation as IF  # noqa: E402


@register("anomaly_scores")
def q_anomaly_scores(spark, sf_dir):
    """Isolation-forest decision scores and ±1 labels for every feature-matrix row."""
    data, feats = whole_frame(spark, sf_dir)
    model, scores = IF.fit_scored(data, feats, "vec_id", n_trees=100, psi=256, contamination=0.018)
    lab = IF.label(scores, model["offset"])
    return lab.select("vec_id", round6("decision").alias("decision"), "anomaly_label")


@register("scorecard_with_anomaly")
def q_scorecard_with_anomaly(spark, sf_dir):
    """Transactions scored with the forest's decision score blended in and rule U04."""
    txn = transactions(Tables(spark, sf_dir))
    feats = ["F115", "F321", "F527", "F670"]
    # written once, as the scorer and the forest read them: the joins behind the transactions run once
    txn = txn.drop("transaction_id", "sender_id", "receiver_id", "ts", K.TARGET_COLUMN)
    path = scratch_path(spark, "anomaly-transactions")
    txn.select("*", *[F.coalesce(F.try_element_at("custom_metrics", F.lit(f)), F.lit(0.0)).alias(f"m_{f}") for f in feats]).write.parquet(path)
    both = spark.read.parquet(path)
    flat, txn = both.select("seq", *[f"m_{f}" for f in feats]), both.select(*txn.columns)
    mfeats = [f"m_{f}" for f in feats]
    model, scores = IF.fit_scored(flat, mfeats, "seq", n_trees=100, psi=256, contamination=0.018)
    lab = IF.label(scores, model["offset"])
    b = IF.bounds(lab).first()
    joined = txn.join(lab.select("seq", F.col("decision").alias("anomaly_score"), "anomaly_label"), "seq")
    s = score_transactions(joined, bounds=(b["anomaly_score_min"], b["anomaly_score_max"]), with_attribution=False)
    return s.groupBy("risk_tier", "is_unsupervised_outlier").agg(F.count(F.lit(1)).alias("n"),
                                                                round6(F.avg("anomaly_risk")).alias("avg_anomaly_risk"))


# ---------------------------------------------------------------- sources and sinks

from ..sources import io as IO  # noqa: E402


@register("alert_snapshot_roundtrip")
def q_alert_snapshot_roundtrip(spark, sf_dir):
    """Workflow state written as a JSON snapshot, read back with a fixed schema."""
    alerts, logs, after, update_logs, _ = workflow(spark, sf_dir)
    path = scratch_path(spark, "alert-snapshot")
    IO.write_alert_snapshot(after, logs.unionByName(update_logs), path)
    a, lg = IO.read_alert_snapshot(spark, path)
    n_logs = lg.groupBy("alert_key").agg(F.count(F.lit(1)).alias("n_logs"))
    upd = update_logs.groupBy("alert_key").agg(F.countDistinct(F.floor(F.col("log_seq") / 4)).alias("n_updates"))
    return a.join(n_logs, "alert_key", "left").join(upd, "alert_key", "left").select(
            "id", "status", "assigned_to", F.coalesce(F.col("n_updates"), F.lit(0)).cast("bigint").alias("n_updates"),
            F.coalesce(F.col("n_logs"), F.lit(0)).cast("bigint").alias("n_logs"))


@register("risk_scores_csv_roundtrip")
def q_risk_scores_csv(spark, sf_dir):
    """Scored-batch CSV written and scanned back; per-band sums."""
    batch = AL.batch_risk_scores(scored(spark, sf_dir))
    path = scratch_path(spark, "risk-scores-csv")
    IO.write_risk_scores(batch, path)
    r = IO.read_risk_scores(spark, path)
    band = F.when(F.col("Final_Risk_Score") >= 75, "Critical").when(F.col("Final_Risk_Score") >= 50, "High") \
        .when(F.col("Final_Risk_Score") >= 25, "Medium").otherwise("Low")
    return r.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"),
                                              round6(F.avg("ML_Risk")).alias("avg_ml_risk"),
                                              round6(F.avg("Final_Risk_Score")).alias("avg_final"))


@register("feature_csv_scan")
def q_feature_csv_scan(spark, sf_dir):
    """Feature matrix through CSV (index column, leakage column, text numerics) and back."""
    fm = features(spark, sf_dir).withColumn("F3912", F.col("F0") * F.lit(2.0)) \
        .withColumn("F7", F.col("F7").cast("string"))
    path = scratch_path(spark, "feature-csv")
    IO.write_feature_csv(fm, path)
    raw = IO.read_feature_csv(spark, [scratch_path(spark, "missing"), path])
    clean, t = IO.clean_feature_frame(raw, TARGET)
    p = PR.missing_profile(clean, [c for c in clean.columns if c not in ("vec_id", t)])
    return p.select("feature", F.col("missing_count").cast("bigint").alias("missing_count"),
                    round6("missing_percentage").alias("missing_percentage"))


@register("stream_workflow_state")
def q_stream_workflow_state(spark, sf_dir):
    """Update requests streamed into an append-only log and folded; must equal
    the batch fold (alert_workflow_state)."""
    from ..streaming import workflow_stream as WS

    alerts, _ = alert_store(spark, sf_dir)
    updates = alert_updates(Tables(spark, sf_dir))
    base, src = scratch_path(spark, "workflow-state"), scratch_path(spark, "workflow-updates")
    WS.open_store(alerts, base, updates)
    updates.repartition(16, "update_seq").write.parquet(src)
    WS.run_workflow_stream(spark, src, spark.read.parquet(src).schema, base)
    a, lg = WS.current_state(spark, base)
    n_logs = lg.groupBy("alert_key").agg(F.count(F.lit(1)).alias("n_logs"))
    return a.join(n_logs, "alert_key", "left").select(
        "id", "status", "assigned_to", F.col("n_updates").cast("bigint").alias("n_updates"),
        F.coalesce(F.col("n_logs"), F.lit(0)).cast("bigint").alias("n_logs"))


@register("recent_quarter_tiers")
def q_recent_quarter_tiers(spark, sf_dir):
    """Scorecard tiers over the last quarter (90 days) before the latest transaction."""
    s = AN.time_range(scored(spark, sf_dir), "quarter")
    return s.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n"),
                                      F.min("ts").cast("string").alias("first_ts"))


@register("tree_shap_importance")
def q_tree_shap_importance(spark, sf_dir):
    """Exact TreeSHAP of the boosted-tree model on every row; mean |φ| per feature."""
    from ..operators import tree_shap as TS

    d = training_frame(spark, sf_dir, select=False)
    feats = d.preprocessor.numeric_features
    gbt = MD.fit(d.train, feats, TARGET, names=["xgboost"])["xgboost"].stages[-1]
    data = d.preprocessor.transform(features(spark, sf_dir))
    ex = TS.explain_trees(data, gbt, feats, "vec_id")
    return ex.groupBy("feature").agg(round6(F.avg(F.abs("shap"))).alias("mean_abs_shap"),
                                     round6(F.avg("shap")).alias("mean_shap"))


@register("smote_rows")
def q_smote_rows(spark, sf_dir):
    """Each synthetic row's origin, neighbour, fraction and sum of values (exact neighbours)."""
    from ..operators import smote as SM

    x = SM.synthetic(features(spark, sf_dir), [f"F{i}" for i in range(64)], TARGET, "vec_id")
    return x.select("draw", "vec_id", "neighbour", round6("u").alias("u"),
                    F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("sum_x"))


@register("smote_classes")
def q_smote_classes(spark, sf_dir):
    """Class counts after SMOTE of the training rows (neighbours by projections)."""
    from ..operators import smote as SM

    d = training_frame(spark, sf_dir, select=False)
    out = SM.smote(d.train, d.preprocessor.numeric_features, TARGET, "vec_id", method="projections")
    return out.groupBy(F.col(TARGET).cast("bigint").alias("label")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- store paths, filters, exports


@register("alerts_against_store")
def q_alerts_against_store(spark, sf_dir):
    """Requests against a store that holds every second alert: new alerts and requests that have one."""
    ensure_checkpoint_dir(spark)
    # what alerts are made of: the scored rows' features and attributions stay out of the checkpoint
    s = scored(spark, sf_dir).select("seq", "transaction_id_n", "sender_id", "receiver_id", "amount_n", "final_risk_score", "risk_tier",
                                     "alert_severity", "rule_hits", "key_drivers", "ts").checkpoint(eager=True)
    store = AL.materialize_alerts(s)[0].filter("seq % 2 = 0").checkpoint(eager=True)
    new, _ = AL.materialize_alerts(s, store)
    known = AL.existing_alert_for(store, s)
    return new.agg(F.lit("new").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("seq").cast("bigint").alias("sum_seq")).unionByName(
        known.agg(F.lit("existing").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("seq").cast("bigint").alias("sum_seq")))


@register("backfill_into_store")
def q_backfill_into_store(spark, sf_dir):
    """A back-fill replaces the store's earlier back-fill rows and keeps the others."""
    ensure_checkpoint_dir(spark)
    alerts = alert_store(spark, sf_dir)[0].checkpoint(eager=True)
    old = F.when(F.col("seq") % 10 == 0, F.concat(F.lit("ALT-DS-"), F.col("seq").cast("string"))).when(
        F.col("seq") % 10 == 1, F.concat(F.lit("ALT-LOW-"), F.col("seq").cast("string"))).otherwise(F.col("id"))
    both, _ = AL.backfill_alerts(AL.batch_risk_scores(scored(spark, sf_dir)), alerts.withColumn("id", old))
    return both.groupBy(F.col("id").startswith("ALT-DS-").alias("backfilled"), "status").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_score").cast("bigint").alias("sum_score"))


@register("score_range_by_source")
def q_score_range_by_source(spark, sf_dir):
    """Scores 60 to 89 of each data source, by status tab."""
    _, _, after, _, _ = workflow(spark, sf_dir)
    v = AN.score_range(AN.alert_view(after), 60, 89)
    parts = [AN.data_source(v, src).groupBy(F.lit(src).alias("source"), "status").agg(F.count(F.lit(1)).alias("n"))
             for src in ("live-all", "live-target", "live-dataset")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _flat_model():
    return LinearModel([f"F{i}" for i in range(8)], [(i - 3) / 2.0 for i in range(8)], 0.25)


@register("direct_predictions")
def q_direct_predictions(spark, sf_dir):
    """Probability and class of a linear model; a feature that a row lacks is its background mean."""
    from ..operators.scoring import predict

    fm = features(spark, sf_dir).withColumn("F7", F.when(F.col("vec_id") % 3 > 0, F.col("F7")))
    p = predict(fm, _flat_model())
    return p.select("vec_id", round6("fraud_probability").alias("fraud_probability"), F.col("predicted_class_label").cast("bigint").alias("label"))


@register("linear_proxy")
def q_linear_proxy(spark, sf_dir):
    """(value - mean) x importance, mean |attribution| by feature."""
    fm, model = features(spark, sf_dir), _flat_model()
    weights = model.importance_weights()
    a = AT.linear_proxy_attribution(fm, {f: 0.01 for f in model.features}, weights)
    return a.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"attr_{f}").alias("v")) for f in model.features]))) \
        .groupBy("feature").agg(round6(F.avg(F.abs("v"))).alias("mean_abs"))


@register("selected_matrix")
def q_selected_matrix(spark, sf_dir):
    """P5: the selector's columns, one of which the table lacks."""
    return SE.select_features(features(spark, sf_dir), ["F3", "F_missing", "F1"], "vec_id").select(
        "vec_id", round6("F3").alias("F3"), round6("F_missing").alias("F_missing"), round6("F1").alias("F1"))


@register("scorecard_records")
def q_scorecard_records(spark, sf_dir):
    """Fields of the nested scorecard record."""
    from ..operators.scoring import scorecard_struct

    r = scored(spark, sf_dir).select(scorecard_struct(None).alias("r"))
    return r.select("r.transaction_id", F.col("r.scores.base_ml_score").cast("bigint").alias("base_ml_score"),
                    F.col("r.scores.final_risk_score").cast("bigint").alias("final_risk_score"), "r.categorizations.risk_tier", "r.categorizations.action_decision",
                    F.size("r.rules_audit.overrides").cast("bigint").alias("n_overrides"))


@register("anomaly_blend")
def q_anomaly_blend(spark, sf_dir):
    """Scorecards with a given anomaly score and label blended in."""
    txn = transactions(Tables(spark, sf_dir))
    txn = txn.withColumn("anomaly_score", (F.col("seq") * 7 % 101) / F.lit(100.0) - F.lit(0.5)).withColumn(
        "anomaly_label", F.when(F.col("seq") % 20 == 0, F.lit(-1)).otherwise(F.lit(1)))
    s = score_transactions(txn, bounds=(-0.5, 0.5), with_attribution=False)
    return s.groupBy("risk_tier", "is_unsupervised_outlier").agg(
        F.count(F.lit(1)).alias("n"), round6(F.avg("anomaly_risk")).alias("avg_anomaly_risk"), F.sum("final_risk_score").cast("bigint").alias("sum_score"))


@register("report_exports")
def q_report_exports(spark, sf_dir):
    """Explorer and outlier reports written as CSV and scanned back."""
    _, _, after, _, _ = workflow(spark, sf_dir)
    view = AN.alert_view(after)
    ensure_checkpoint_dir(spark)
    view = view.checkpoint(eager=True)
    out = {"explorer": IO.explorer_export(view), "outliers": IO.outlier_export(AN.outlier_points(view))}
    parts = []
    for name, (score, df) in {"explorer": ("Risk Score", out["explorer"]), "outliers": ("Score", out["outliers"])}.items():
        path = scratch_path(spark, f"report-{name}")
        IO.export_csv(df, path)
        back = spark.read.option("header", True).csv(path)
        parts.append(back.agg(F.lit(name).alias("report"), F.lit(len(back.columns)).cast("bigint").alias("n_columns"), F.count(F.lit(1)).alias("n"),
                              F.sum(F.col(f"`{score}`").cast("bigint")).cast("bigint").alias("sum_score")))
    return parts[0].unionByName(parts[1])


@register("preprocessor_roundtrip")
def q_preprocessor_roundtrip(spark, sf_dir):
    """A fitted preprocessor saved, loaded and applied; must equal preprocessed_matrix."""
    fm = features(spark, sf_dir)
    path = scratch_path(spark, "preprocessor")
    GovernancePreprocessor().fit(fm, TARGET, exclude=["vec_id"]).save(spark, path)
    return _matrix_rows(PreprocessorModel.load(spark, path).transform(fm))


# ---------------------------------------------------------------- trees with random thresholds

from ..functions import scalar as SC  # noqa: E402
from ..operators import random_trees as RT  # noqa: E402
from ..operators.flat_trees import FlatTrees  # noqa: E402

DIMS = [f"F{i}" for i in range(64)]
FOREST_TREES, FOREST_DEPTH = 20, 8


def extra_trees_model(spark, sf_dir) -> FlatTrees:
    return RT.extra_trees(features(spark, sf_dir), DIMS, TARGET, n_trees=FOREST_TREES, depth=FOREST_DEPTH)


@register("extra_trees_splits")
def q_extra_trees_splits(spark, sf_dir):
    """M3: every node of a forest of random thresholds: its split, or its share of label 1."""
    nodes = extra_trees_model(spark, sf_dir).nodes(spark)
    return nodes.select(F.col("tree").cast("bigint").alias("tree"), F.col("node").cast("bigint").alias("node"),
                        F.col("feature").cast("bigint").alias("feature"), round6("threshold").alias("threshold"), round6("value").alias("value"))


@register("isolation_forest")
def q_isolation_forest(spark, sf_dir):
    """A forest of 100 trees, saved, loaded and scored on every row, with the bounds of its decisions."""
    fm = features(spark, sf_dir)
    path = scratch_path(spark, "isolation-forest")
    IF.save(IF.fit(fm, DIMS, "vec_id"), spark, path)
    model = IF.load(spark, path)
    lab = IF.label(IF.score(fm, model, "vec_id"), model["offset"])
    b = IF.bounds(lab)
    return lab.crossJoin(F.broadcast(b)).select("vec_id", round6("score").alias("score"), round6("decision").alias("decision"),
                                                F.col("anomaly_label").cast("bigint").alias("anomaly_label"),
                                                round6("anomaly_score_min").alias("least"), round6("anomaly_score_max").alias("most"))


# ---------------------------------------------------------------- boosted trees

from dataclasses import replace  # noqa: E402

from ..operators import boosting as BO  # noqa: E402

# rounds of the registered fits; each level of each tree is a job
WEIGHTED_ROUNDS, LEAF_WISE_ROUNDS = 20, 10


def _tree_rows(spark, model: BO.Boosted, number: int) -> DataFrame:
    """Nodes of one tree: place among the splits (0 at a leaf), split and sums."""
    tree, s = model.history[number], model.settings
    place = {n: i + 1 for i, n in enumerate(tree.order)}
    rows = []
    for n in [*tree.order, *tree.leaves()]:
        x, split = tree.nodes[n], n in place
        rows.append((n, place.get(n, 0), x.feature if split else -1, model.cuts[x.feature][x.cut] if split else 0.0,
                     x.gain if split else 0.0, x.count, x.g / BO.UNIT, x.h / BO.UNIT, 0.0 if split else tree.value(n, s)))
    df = spark.createDataFrame(rows, "node bigint, place bigint, feature bigint, threshold double, gain double, n bigint, g double, h double, value double")
    return df.withColumns({c: F.round(c, 5) for c in ("threshold", "gain", "g", "h", "value")})


@register("boosted_tree")
def q_boosted_tree(spark, sf_dir):
    """M4: boosting of depth 5 with row and column samples and class weight 111; the first tree's nodes with their sums."""
    model = BO.fit(features(spark, sf_dir), DIMS, TARGET, "vec_id", replace(BO.BOOSTED_WEIGHTED, trees=WEIGHTED_ROUNDS))
    return _tree_rows(spark, model, 0).drop("place")


@register("leaf_wise_tree")
def q_leaf_wise_tree(spark, sf_dir):
    """M5: best-first growth to 31 leaves; the first tree's nodes in the order of their splits."""
    model = BO.fit(features(spark, sf_dir), DIMS, TARGET, "vec_id", replace(BO.LEAF_WISE, trees=LEAF_WISE_ROUNDS))
    return _tree_rows(spark, model, 0)


# ---------------------------------------------------------------- elimination from given weights

@register("elimination_rounds")
def q_elimination_rounds(spark, sf_dir):
    """The round in which each feature goes when its weight is the difference of the classes' means."""
    fm = features(spark, sf_dir)
    gap = [F.round(F.abs(F.avg(F.when(F.col(TARGET) == 1, F.col(c))) - F.avg(F.when(F.col(TARGET) == 0, F.col(c)))), 9).alias(c) for c in DIMS]
    weights = fm.agg(*gap).first().asDict()
    rounds = MD.eliminated_in(DIMS, weights, K.RFE_STEP, K.RFE_MIN_FEATURES)
    return spark.createDataFrame([(f, weights[f], rounds[f]) for f in DIMS], "feature string, weight double, dropped_in bigint").withColumn("weight", round6("weight"))


# ---------------------------------------------------------------- Shapley values of any model

from ..operators import shapley as SH  # noqa: E402

SHAPLEY_PAIRS = 4


def _shapley(spark, sf_dir, pairs):
    fm, model = features(spark, sf_dir), _flat_model()
    background = fm.agg(*[F.avg(f).alias(f) for f in model.features]).first().asDict()
    return SH.explained(fm, model, background, "vec_id", pairs).withColumn("shap", F.round("shap", 6))


@register("shapley_exact")
def q_shapley_exact(spark, sf_dir):
    """Shapley values of a model's probability over all sets of its eight features."""
    return _shapley(spark, sf_dir, None)


@register("shapley_sampled")
def q_shapley_sampled(spark, sf_dir):
    """The same from drawn orders and their reverses."""
    return _shapley(spark, sf_dir, SHAPLEY_PAIRS)


# ---------------------------------------------------------------- keyed stream state

@register("stream_keyed_state")
def q_stream_keyed_state(spark, sf_dir):
    """The update requests through keyed state with timers; must equal the fold of the log (stream_workflow_state)."""
    from ..streaming import workflow_state as KS

    alerts, _ = alert_store(spark, sf_dir)
    updates = alert_updates(Tables(spark, sf_dir))
    base, src, ckpt = (scratch_path(spark, n) for n in ("keyed-state", "keyed-updates", "keyed-ckpt"))
    KS.open_state(alerts, base)
    updates.repartition(8, "update_seq").write.parquet(src)
    schema = spark.read.parquet(src).schema
    KS.run_state_stream(spark, src, schema, base, ckpt, delay=YEARLY_FILES)
    KS.close(spark, spark.read.schema(schema).parquet(src), src)
    KS.run_state_stream(spark, src, schema, base, ckpt, delay=YEARLY_FILES)
    after, update_logs = KS.state_of(spark, base)
    logs = AL.opening_logs(after)  # of the alerts as written: the store is built once
    n_logs = logs.select("alert_key").unionByName(update_logs.select("alert_key")).groupBy("alert_key").agg(F.count(F.lit(1)).alias("n_logs"))
    return after.join(n_logs, "alert_key", "left").select(
        "id", "status", "assigned_to", F.col("n_updates").cast("bigint").alias("n_updates"),
        F.coalesce(F.col("n_logs"), F.lit(0)).cast("bigint").alias("n_logs"))


# ---------------------------------------------------------------- ML stages and versions of the store

@register("ml_pipeline_matrix")
def q_ml_pipeline_matrix(spark, sf_dir):
    """The preprocessed matrix from a pyspark.ml Pipeline that was saved and loaded."""
    from pyspark.ml import Pipeline, PipelineModel

    from ..operators.ml_stages import GovernanceStage

    fm, path = features(spark, sf_dir), scratch_path(spark, "governance-pipeline")
    Pipeline(stages=[GovernanceStage(labelCol=TARGET, keyCol="vec_id")]).fit(fm).write().save(path)
    return _matrix_rows(PipelineModel.load(path).transform(fm))


@register("alert_store_versions")
def q_alert_store_versions(spark, sf_dir):
    """The opening store and the updated one committed in turn; rows of each version and status, and of seeds where no store is."""
    from ..sources import snapshots as SN

    alerts, logs, after, update_logs, _ = workflow(spark, sf_dir)
    base = scratch_path(spark, "alert-store")
    seeded, _ = SN.read(spark, base, seed=(alerts.where("seq % 100 = 0"), logs))
    SN.commit(alerts, logs, base)
    opened, _ = SN.read(spark, base)
    SN.commit(after, logs.unionByName(update_logs), base)
    updated, _ = SN.read(spark, base)
    versions = [f.select(F.lit(n).alias("version"), "status") for n, f in (("seed", seeded), ("opened", opened), ("updated", updated))]
    return versions[0].unionByName(versions[1]).unionByName(versions[2]).groupBy("version", "status").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- audits, records and exports

@register("preprocess_audit")
def q_preprocess_audit(spark, sf_dir):
    """Columns dropped by reason and what is left, counts and lists."""
    a = GovernancePreprocessor().fit(features(spark, sf_dir), TARGET, exclude=["vec_id"]).audit(spark)
    return a.select("section", "n", F.array_join("features", ",").alias("features"))


@register("selection_audit")
def q_selection_audit(spark, sf_dir):
    """Collinear columns dropped, the 15 best by mutual information and the columns retained."""
    fm = features(spark, sf_dir)
    ensure_checkpoint_dir(spark)
    dropped = SE.collinear_dropped(SE.collinear_pairs(fm, collinear_columns(fm))).checkpoint(eager=True)
    ranked = MI.top_k_features(MI.mutual_information(fm, mi_features(fm), TARGET), 40).checkpoint(eager=True)
    gone = {r.col_j for r in dropped.collect()}
    best = [r.feature for r in ranked.orderBy("mi_rank").collect()]
    a = SE.audit(dropped, ranked, [f for f in best if f not in gone])
    return a.select("section", "n", F.array_join("features", ",").alias("features"))


@register("forced_features")
def q_forced_features(spark, sf_dir):
    """U4/P5: regulatory features that the matrix has join the selection behind the chosen ones, in their order."""
    fm = features(spark, sf_dir).withColumnsRenamed({"F60": "F670", "F61": "F115", "F62": "F3894"})
    chosen = SE.force_include(["F4", "F115", "F2"], fm.columns)
    x = SE.select_features(fm, chosen, "vec_id")
    return x.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in chosen])).alias("position", "e")) \
        .groupBy(F.col("position").cast("bigint").alias("position"), F.col("e.feature").alias("feature")).agg(round6(F.sum("e.v")).alias("sum_value"))


REQUESTS = ["XGBoost_classifier", "Random Forest", " logisticregression", "no such model"]


@register("active_models")
def q_active_models(spark, sf_dir):
    """The model that each requested name means, and its mean probability; the fallback where no model is."""
    fm = features(spark, sf_dir)
    x = {f: F.col(f) for f in DIMS}
    models = {n: LinearModel(["F0", "F1"], [1.0 + i, -0.5 * i], 0.1 * i) for i, n in enumerate(("logisticregression", "xgboost", "randomforest"))}
    asked = [(r, *MD.active_probability(r, models, x)) for r in REQUESTS] + [("any", *MD.active_probability("any", {}, x))]
    each = F.array(*[F.struct(F.lit(r).alias("request"), F.lit(n).alias("model"), p.alias("p")) for r, n, p in asked])
    return fm.select(F.inline(each)).groupBy("request", "model").agg(round6(F.avg("p")).alias("mean_probability"))


@register("anomaly_record")
def q_anomaly_record(spark, sf_dir):
    """M8: the evaluation record of the isolation forest."""
    fm = features(spark, sf_dir)
    model, scores = IF.fit_scored(fm, DIMS, "vec_id")
    lab = IF.label(scores, model["offset"]).join(fm.select("vec_id", TARGET), "vec_id")
    r = MD.anomaly_record(lab, TARGET)
    return r.select("model", *[round6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")], "tn", "fp", "fn", "tp")


@register("tree_importance")
def q_tree_importance(spark, sf_dir):
    """Shares of the gains of a boosted model's splits, and attributions weighted by them."""
    fm = features(spark, sf_dir)
    weights = BO.fit(fm, DIMS, TARGET, "vec_id", replace(BO.BOOSTED, trees=1)).importance_weights()
    used = {f: w for f, w in weights.items() if w}
    a = AT.linear_proxy_attribution(fm, {f: 0.01 for f in used}, used)
    sums = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(w).alias("weight"), F.col(f"attr_{f}").alias("v")) for f, w in used.items()])
    return a.select(F.inline(sums)).groupBy("feature").agg(round6(F.first("weight")).alias("weight"), round6(F.avg(F.abs("v"))).alias("mean_abs"))


@register("metrics_report")
def q_metrics_report(spark, sf_dir):
    """The metrics record written as JSON and read back, then exported as CSV."""
    record = EV.confusion_metrics(scored_labels(spark, sf_dir), "y", EV.predicted_label("probability")).select(
        F.lit("proxy").alias("model"), "accuracy", "recall", "f1", "fp", "tn")
    path, out = scratch_path(spark, "metrics"), scratch_path(spark, "metrics-csv")
    IO.write_json_record(record, path)
    IO.export_csv(IO.metrics_export(IO.read_json_record(spark, path, record.schema.simpleString()[7:-1].replace(":", " "))), out)
    back = spark.read.option("header", True).csv(out)
    return back.select(F.col("Model").alias("model"), F.col("Accuracy (%)").cast("double").alias("accuracy_pct"),
                       F.col("FPR (%)").cast("double").alias("fpr_pct"), F.col("Recall (%)").cast("double").alias("recall_pct"), F.col("F1").cast("double").alias("f1"))


@register("top_driver_report")
def q_top_driver_report(spark, sf_dir):
    """The four most important features with what one transaction shows of them, exported as CSV."""
    ex, _ = explained(spark, sf_dir)
    long = AT.attribution_long(ex)
    top = AT.top_features(AT.global_importance(long), 4)
    one = long.where("row_id = 'TXN-1'").select("feature", F.when(F.col("value") > 0, "Risk Increasing").otherwise("Risk Reducing").alias("type"),
                                                F.col("value").alias("shap_value"), F.format_string("%.2f", "raw_value").alias("value"))
    cards = AT.catalog_enrich(top, one)
    path = scratch_path(spark, "drivers")
    IO.export_csv(IO.importance_export(cards), path)
    back = spark.read.option("header", True).csv(path).select(F.col("Feature ID").alias("feature"), F.col("Score").cast("double").alias("score"))
    return cards.join(back, "feature").select("feature", "name", "type", _z("shap_value").alias("shap_value"), "value", _z("score").alias("score"))


@register("sanctioned_origins")
def q_sanctioned_origins(spark, sf_dir):
    """Transactions from the countries of a given list (semi-join), with their money in short form."""
    listed = spark.createDataFrame([(c,) for c in K.SANCTIONED_COUNTRIES], "code string")
    t = IO.sanctioned_semi_join(transactions(Tables(spark, sf_dir)), listed, "origin_country")
    sums = t.groupBy("origin_country").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(20,2)")).cast("double").alias("total"), F.min("amount").alias("least"))
    return sums.select("origin_country", "n", SC.compact_currency("total").alias("total"), SC.compact_currency("least").alias("least"))


# ---------------------------------------------------------------- trainers with the reference's settings

from ..operators import trainers as TN  # noqa: E402


@register("trainer_metrics")
def q_trainer_metrics(spark, sf_dir):
    """M1/M3–M5/M7: boosting level-wise, weighted and leaf-wise, random-threshold trees and L1 logistic on the training rows; records on the held-out ones."""
    d = training_frame(spark, sf_dir)
    ensure_checkpoint_dir(spark)
    train = MD.random_oversample(d.train, TARGET, "vec_id").checkpoint(eager=True)
    p = TN.fit(train, d.features, TARGET, "vec_id")
    p["ensemble"] = (p["xgboost"] + p["lightgbm"] + p["extratrees"]) / F.lit(3.0)
    test = d.test.select(TARGET, *[c.alias(f"p_{n}") for n, c in p.items()]).checkpoint(eager=True)
    records = [MD.evaluation_record(test, f"p_{n}", TARGET, n) for n in p]
    out = records[0]
    for r in records[1:]:
        out = out.unionByName(r)
    return out.select("model", *[round6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")], "tn", "fp", "fn", "tp")
