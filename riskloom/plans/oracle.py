"""DuckDB SQL oracle for the registered queries (same names as the catalog)."""

from __future__ import annotations

from .. import constants as K
from .sql_fixtures import scored_cte, transactions_cte, with_ctes

ORACLE: dict[str, str] = {}


def _scored() -> str:
    return with_ctes(transactions_cte(), scored_cte())


ORACLE["scorecard_rows"] = _scored() + """
SELECT transaction_id, round(p, 6) AS probability, ml_score, blended_score, blended_tier,
       CAST(final_risk_score AS BIGINT) AS final_risk_score, risk_tier, alert_severity, action_decision,
       triggered_rules_count, rule_ids, driver_features
FROM scored"""

ORACLE["scorecard_tiers"] = _scored() + f"""
SELECT risk_tier, action_decision, count(*) AS n_transactions,
       count(*) FILTER (WHERE final_risk_score > {K.ALERT_THRESHOLD}) AS n_alerts,
       count(*) FILTER (WHERE elevated) AS n_elevated,
       round(avg(p), 6) AS avg_probability
FROM scored GROUP BY risk_tier, action_decision"""

ORACLE["blended_tiers"] = _scored() + """
SELECT blended_tier, count(*) AS n_transactions, CAST(min(blended_score) AS BIGINT) AS min_score,
       CAST(max(blended_score) AS BIGINT) AS max_score
FROM scored GROUP BY blended_tier"""

ORACLE["rule_hit_counts"] = _scored() + f"""
SELECT rule_id, count(*) AS n_hits, count(*) FILTER (WHERE trigger_score > blended_score) AS n_above_model
FROM (
  SELECT '{K.RULE_G01_ID}' AS rule_id, {K.RULE_SCORES[K.RULE_G01_ID][0]} AS trigger_score, blended_score FROM scored WHERE hit_g01
  UNION ALL
  SELECT '{K.RULE_V02_ID}', {K.RULE_SCORES[K.RULE_V02_ID][0]}, blended_score FROM scored WHERE hit_v02
  UNION ALL
  SELECT '{K.RULE_A03_ID}', {K.RULE_SCORES[K.RULE_A03_ID][0]}, blended_score FROM scored WHERE hit_a03
) h GROUP BY rule_id"""


# ---------------------------------------------------------------- milestone 2
from .sql_fixtures import alert_view_cte, alerts_cte, workflow_cte  # noqa: E402


def _alerts() -> str:
    return with_ctes(transactions_cte(), scored_cte(), alerts_cte())


def _workflow() -> str:
    return with_ctes(transactions_cte(), scored_cte(), alerts_cte(), workflow_cte())


def _view() -> str:
    return with_ctes(transactions_cte(), scored_cte(), alerts_cte(), workflow_cte(), alert_view_cte())


ALERT_OUT = """id, transaction_id, sender_id, receiver_id, round(amount, 6) AS amount, CAST(risk_score AS BIGINT) AS risk_score,
       risk_tier, severity, status, reason, timestamp, assigned_to"""

ORACLE["alerts_materialized"] = _alerts() + f"\nSELECT {ALERT_OUT} FROM alerts"

ORACLE["alert_telemetry"] = _workflow() + """
SELECT count(*) AS total_incidents_recorded, round(coalesce(avg(risk_score), 0.0), 6) AS average_risk_rating,
       CAST(coalesce(max(risk_score), 0) AS BIGINT) AS maximum_index_severity,
       count(*) FILTER (WHERE status = 'Open') AS status_open,
       count(*) FILTER (WHERE status = 'Investigating') AS status_investigating,
       count(*) FILTER (WHERE status = 'Escalated') AS status_escalated,
       count(*) FILTER (WHERE status = 'Closed') AS status_closed,
       count(*) FILTER (WHERE coalesce(severity, 'Medium') = 'Critical') AS severity_critical,
       count(*) FILTER (WHERE coalesce(severity, 'Medium') = 'High') AS severity_high,
       count(*) FILTER (WHERE coalesce(severity, 'Medium') = 'Medium') AS severity_medium,
       count(*) FILTER (WHERE coalesce(severity, 'Medium') = 'Low') AS severity_low
FROM after"""

ORACLE["alert_workflow_state"] = _workflow() + """,
n_logs AS (SELECT alert_key, count(*) AS n FROM (SELECT transaction_id AS alert_key FROM alerts UNION ALL SELECT alert_key FROM update_logs) x GROUP BY alert_key)
SELECT a.id, a.status, a.assigned_to, CAST(a.n_updates AS BIGINT) AS n_updates, CAST(coalesce(n.n, 0) AS BIGINT) AS n_logs
FROM after a LEFT JOIN n_logs n ON n.alert_key = a.transaction_id"""

ORACLE["alert_workflow_logs"] = _workflow() + "\nSELECT alert_id, CAST(log_seq AS BIGINT) AS log_seq, operator, action, timestamp FROM update_logs"

ORACLE["update_rejections"] = _workflow() + """
SELECT event_type, reason, count(*) AS n_rejected
FROM (SELECT event_type, 'unknown account' AS reason FROM rejected UNION ALL SELECT event_type, 'invalid status' FROM invalid) r
GROUP BY event_type, reason"""

ORACLE["alert_view"] = _view() + """
SELECT id, account_number, type, CAST(risk_score AS BIGINT) AS risk_score,
       CASE WHEN risk_score >= 80 THEN 'High' WHEN risk_score >= 60 THEN 'Medium' ELSE 'Low' END
         || ' (' || CAST(confidence_val AS VARCHAR) || '%)' AS confidence,
       confidence_val, status, holder_name, round(balance, 6) AS balance, round(ytd_inflows, 6) AS ytd_inflows,
       prio, assigned_to
FROM view"""


def _js_round(x: str) -> str:
    return f"CAST(floor({x} + CAST(0.5 AS DOUBLE)) AS BIGINT)"


ORACLE["dashboard_kpis"] = _view() + f""",
k AS (
  SELECT count(*) AS n,
         count(*) FILTER (WHERE risk_score < 50) AS low_count,
         count(*) FILTER (WHERE risk_score >= 50 AND risk_score < 75) AS med_count,
         count(*) FILTER (WHERE contains(lower(type), 'mule') OR contains(lower(type), 'target') OR contains(lower(type), 'fraud')) AS mule_count,
         count(*) FILTER (WHERE NOT (contains(lower(type), 'mule') OR contains(lower(type), 'target') OR contains(lower(type), 'fraud'))
                          AND (contains(lower(type), 'network') OR contains(lower(type), 'ip') OR contains(lower(type), 'proxy')
                               OR contains(lower(type), 'sanction') OR contains(lower(type), 'ofac'))) AS network_count,
         coalesce(sum(balance) FILTER (WHERE risk_score >= 75), 0.0) AS total_risk_amount,
         coalesce(sum(balance) FILTER (WHERE type = 'Mule Account'), 0.0) AS total_target_amount,
         count(*) FILTER (WHERE risk_score >= 50) AS n_score_50,
         count(*) FILTER (WHERE risk_score >= 75) AS n_score_75,
         avg(confidence_val) AS mean_confidence,
         avg(CASE WHEN status <> 'Open' THEN 1.0 ELSE 0.0 END) AS mitigation_rate,
         count(*) FILTER (WHERE starts_with(id, 'ALT-TGT-') OR risk_score >= 50) AS n_target,
         count(*) FILTER (WHERE starts_with(id, 'ALT-DS-')) AS n_dataset
  FROM view
),
k2 AS (SELECT *, CAST(greatest(n, 1) AS DOUBLE) AS total, n - mule_count - network_count AS velocity_count FROM k)
SELECT n AS total_alerts,
       {_js_round('low_count / total * CAST(100.0 AS DOUBLE)')} AS low_pct,
       {_js_round('med_count / total * CAST(100.0 AS DOUBLE)')} AS med_pct,
       100 - {_js_round('low_count / total * CAST(100.0 AS DOUBLE)')} - {_js_round('med_count / total * CAST(100.0 AS DOUBLE)')} AS high_pct,
       CASE WHEN n = 0 THEN {_js_round('total * CAST(0.15 AS DOUBLE)')} ELSE mule_count END AS mule_count,
       CASE WHEN n = 0 THEN {_js_round('total * CAST(0.25 AS DOUBLE)')} ELSE network_count END AS network_count,
       CASE WHEN n = 0 THEN 1 - {_js_round('total * CAST(0.15 AS DOUBLE)')} - {_js_round('total * CAST(0.25 AS DOUBLE)')} ELSE velocity_count END AS velocity_count,
       {_js_round('velocity_count / total * CAST(100.0 AS DOUBLE)')} AS velocity_pct,
       {_js_round('network_count / total * CAST(100.0 AS DOUBLE)')} AS network_pct,
       100 - {_js_round('velocity_count / total * CAST(100.0 AS DOUBLE)')} - {_js_round('network_count / total * CAST(100.0 AS DOUBLE)')} AS mule_pct,
       round(total_risk_amount, 2) AS total_risk_amount, round(total_target_amount, 2) AS total_target_amount,
       n_score_50, n_score_75, round(mean_confidence, 6) AS mean_confidence, round(mitigation_rate, 6) AS mitigation_rate,
       n_target, n_dataset
FROM k2"""

ORACLE["queue_counts"] = _view() + """
SELECT status AS tab, count(*) AS n_alerts FROM view GROUP BY status
UNION ALL SELECT 'All', count(*) FROM view"""

ORACLE["alert_list_open_critical"] = _workflow() + """,
f AS (SELECT * FROM after WHERE lower(status) = 'open' AND lower(severity) = 'critical')
SELECT id, CAST(risk_score AS BIGINT) AS risk_score, status, severity, queue_position, alerts_count
FROM (SELECT *, row_number() OVER (ORDER BY seq DESC, id) AS queue_position, count(*) OVER () AS alerts_count FROM f) x
WHERE queue_position <= 1000"""

ORACLE["critical_recent"] = _alerts() + """
SELECT id, CAST(risk_score AS BIGINT) AS risk_score, seq FROM alerts WHERE risk_score > 80 ORDER BY seq DESC, id LIMIT 3"""

ORACLE["explorer_page"] = _view() + """,
f AS (SELECT * FROM view
      WHERE (contains(lower(id), 'acc-1') OR contains(lower(account_number), 'acc-1') OR contains(lower(holder_name), 'acc-1'))
        AND risk_score >= 90),
n AS (SELECT count(*) AS n FROM f),
p AS (SELECT CAST(greatest(1, ceil(n / 5.0)) AS BIGINT) AS pages, n FROM n),
pg AS (SELECT least(2, pages) AS page_no, pages, n FROM p)
SELECT id, account_number, CAST(risk_score AS BIGINT) AS risk_score,
       CAST(CASE WHEN pg.n > 0 THEN (page_no - 1) * 5 + 1 ELSE 0 END AS BIGINT) AS showing_from,
       CAST(least((page_no - 1) * 5 + 5, pg.n) AS BIGINT) AS showing_to, CAST(pg.n AS BIGINT) AS showing_of,
       CAST(pages AS BIGINT) AS n_pages
FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC, id) AS rn FROM f) r, pg
WHERE rn > (page_no - 1) * 5 AND rn <= page_no * 5"""

ORACLE["outlier_points"] = _view() + """
SELECT id, account_number, CAST(risk_score AS BIGINT) AS risk_score,
       round(least(balance / CAST(200000.0 AS DOUBLE) * CAST(280.0 AS DOUBLE) + CAST(20.0 AS DOUBLE), CAST(290.0 AS DOUBLE)), 6) AS x,
       round(CAST(220.0 AS DOUBLE) - risk_score / CAST(100.0 AS DOUBLE) * CAST(180.0 AS DOUBLE), 6) AS y,
       CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'High' ELSE 'Low' END AS label
FROM view WHERE risk_score >= 50"""


def _case(expr: str, table: dict) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _narratives() -> str:
    from ..operators.analytics import CONFIDENCE_TEXT, INDICATOR_TEXT, PREDICTION_TEXT

    band = "CASE WHEN risk_score >= 75 THEN 'critical' WHEN risk_score >= 50 THEN 'high' ELSE 'low' END"
    cval = "coalesce(nullif(confidence_val, 0), 50)"
    cband = f"CASE WHEN {cval} >= 85 THEN 'high' WHEN {cval} >= 60 THEN 'moderate' ELSE 'marginal' END"
    return _view() + f"""
SELECT id, {_case(band, INDICATOR_TEXT)} AS indicator,
       CASE WHEN length(coalesce(reason, '')) > 0 THEN reason ELSE {_case(band, PREDICTION_TEXT)} END AS narrative,
       {_case(cband, CONFIDENCE_TEXT)} AS confidence_text
FROM view"""


ORACLE["case_narratives"] = _narratives()


def _backfill() -> str:
    def tmpl(t):
        head, rest = t.split("{row}")
        mid, tail = rest.split("{ml}")
        return f"'{head}' || CAST(seq AS VARCHAR) || '{mid}' || printf('%.4f', ml_risk) || '{tail}'"

    return with_ctes(transactions_cte(), scored_cte()) + f""",
batch AS (
  SELECT transaction_id, seq, p * CAST(100.0 AS DOUBLE) AS ml_risk,
         CAST({K.ML_WEIGHT} AS DOUBLE) * (p * CAST(100.0 AS DOUBLE)) + CAST({K.ANOMALY_WEIGHT} AS DOUBLE) * CAST(0.0 AS DOUBLE) AS final_risk
  FROM scored
),
sample AS (
  SELECT *, row_number() OVER (ORDER BY seq, transaction_id) AS n,
         greatest(CAST(round_even(final_risk, 0) AS BIGINT), 2) AS score
  FROM batch
)
SELECT printf('ALT-DS-%03d', n) AS id, 'TXN_DS_' || CAST(seq + 1000 AS VARCHAR) AS transaction_id,
       printf('ACC-DS-%03d', n) AS sender_id, printf('ACC-REC-%03d', n) AS receiver_id,
       round(CAST(150 + (seq * 7919) % 1650 AS DOUBLE), 6) AS amount, CAST(score AS BIGINT) AS risk_score,
       CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium' ELSE 'Low' END AS risk_tier,
       CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium' ELSE 'Low' END AS severity,
       CASE WHEN (n - 1) % 2 = 1 THEN 'Closed' ELSE 'Open' END AS status,
       CASE WHEN score >= 50 THEN {tmpl(K.BACKFILL_REASONS['high'])}
            WHEN score >= 25 THEN {tmpl(K.BACKFILL_REASONS['medium'])}
            ELSE {tmpl(K.BACKFILL_REASONS['low'])} END AS reason,
       '2026-05-30T14:00:00Z' AS timestamp,
       CASE WHEN (n - 1) % 2 = 1 THEN '{K.ADMIN_OPERATOR}' ELSE '{K.UNASSIGNED}' END AS assigned_to,
       CAST(CASE WHEN (n - 1) % 2 = 1 THEN 3 ELSE 1 END AS BIGINT) AS n_logs
FROM sample"""


ORACLE["alert_backfill"] = _backfill()


def _ingest() -> str:
    from ..sources.fixtures import INGEST_STATUS
    from .sql_fixtures import _tier_sql

    st = _case("o_orderpriority", INGEST_STATUS)
    band = "CAST(round_even(greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), risk_score / CAST(100.0 AS DOUBLE))) * CAST(100.0 AS DOUBLE), 0) AS BIGINT)"
    states = "(" + ", ".join(f"'{s}'" for s in K.ALERT_STATUSES) + ")"
    return f"""
WITH req AS (
  SELECT CAST(floor(o_totalprice) AS BIGINT) % 101 AS risk_score,
         CASE WHEN o_orderstatus = 'F' THEN 'High' END AS given_tier,
         upper(substr(coalesce({st}, 'Open'), 1, 1)) || lower(substr(coalesce({st}, 'Open'), 2)) AS cap
  FROM orders
),
t AS (SELECT *, {band} AS band FROM req)
SELECT cap AS status, coalesce(given_tier, {_tier_sql('band')}) AS risk_tier, {_tier_sql('band')} AS severity,
       count(*) AS n_alerts
FROM t WHERE cap IN {states} GROUP BY ALL
UNION ALL
SELECT 'REJECTED', NULL, NULL, count(*) FROM t WHERE cap NOT IN {states}"""


ORACLE["alert_ingest"] = _ingest()

ORACLE["rule_exception_kpis"] = _scored() + f"""
SELECT round(avg(CASE WHEN triggered_rules_count > 0 THEN 1.0 ELSE 0.0 END), 6) AS rule_exception_rate,
       count(*) FILTER (WHERE final_risk_score > {K.ALERT_THRESHOLD} AND {K.TARGET_COLUMN} = 1) AS tp,
       count(*) FILTER (WHERE final_risk_score > {K.ALERT_THRESHOLD} AND {K.TARGET_COLUMN} <> 1) AS fp,
       round(coalesce(
         CAST(count(*) FILTER (WHERE final_risk_score > {K.ALERT_THRESHOLD} AND {K.TARGET_COLUMN} = 1) AS DOUBLE)
         / nullif(count(*) FILTER (WHERE final_risk_score > {K.ALERT_THRESHOLD}), 0), 0.0), 6) AS classification_precision
FROM scored"""

ORACLE["weekday_trend"] = with_ctes(transactions_cte()) + """
SELECT dow, day, n, n = max(n) OVER () AS is_spike
FROM (SELECT CAST(dayofweek(ts) + 1 AS BIGINT) AS dow, strftime(ts, '%a') AS day, count(*) AS n
      FROM transactions GROUP BY ALL) g"""

ORACLE["notes_merge"] = _workflow() + """,
local AS (SELECT alert_key, alert_id, notes AS content FROM all_routed WHERE event_type = 'error'),
log_notes AS (
  SELECT DISTINCT alert_key, alert_id, substr(action, 24) AS content FROM update_logs
  WHERE starts_with(action, 'Appended Analyst Note: ')
),
new AS (SELECT l.* FROM log_notes l WHERE NOT EXISTS (SELECT 1 FROM local x WHERE x.alert_key = l.alert_key AND x.content = l.content)),
u AS (SELECT alert_key, alert_id, 0 AS from_log FROM local UNION ALL SELECT alert_key, alert_id, 1 FROM new)
SELECT alert_id, n_notes, n_from_log
FROM (SELECT alert_key, alert_id, count(*) AS n_notes, count(*) FILTER (WHERE from_log = 1) AS n_from_log FROM u GROUP BY alert_key, alert_id) g"""

ORACLE["backfill_sample"] = _scored() + """
SELECT risk_tier, count(*) AS n, CAST(sum(seq) AS BIGINT) AS sum_seq
FROM scored WHERE CAST(('0x' || substr(md5(transaction_id), 1, 8)) AS BIGINT) / 4294967296.0 < 0.25 GROUP BY risk_tier"""


# ---------------------------------------------------------------- milestone 3
from .sql_fixtures import CATEGORICAL_FAULTS, feature_columns, features_cte, numeric_feature_columns  # noqa: E402

T = K.TARGET_COLUMN


def _qi(c: str) -> str:
    return f'"{c}"'


def _nstats_cte() -> str:
    cols = feature_columns()
    parts = []
    for c in numeric_feature_columns():
        x = _qi(c)
        xp = f"CASE WHEN {T} IS NOT NULL THEN {x} END"
        yp = f"CASE WHEN {x} IS NOT NULL THEN CAST({T} AS DOUBLE) END"
        parts.append(
            f"SELECT '{c}' AS feature, {cols.index(c)} AS position, count({x}) AS n, var_pop({x}) AS var_pop, "
            f"avg({x}) AS mean, min({x}) AS min, max({x}) AS max, median({x}) AS median, "
            f"CASE WHEN stddev_pop({xp}) * stddev_pop({yp}) = 0 THEN NULL "
            f"ELSE covar_pop({xp}, {yp}) / (stddev_pop({xp}) * stddev_pop({yp})) END AS corr_target FROM features")
    return "nstats AS (" + "\nUNION ALL ".join(parts) + ")"


def _long_cat_cte() -> str:
    parts = [f"SELECT vec_id, {T}, '{c}' AS feature, {_qi(c)} AS value FROM features" for c in CATEGORICAL_FAULTS]
    return "catlong AS (" + "\nUNION ALL ".join(parts) + ")"


def _cstats_cte() -> str:
    cols = feature_columns()
    parts = [f"SELECT '{c}' AS feature, {cols.index(c)} AS position, count({_qi(c)}) AS n, "
             f"coalesce(min({_qi(c)}) = max({_qi(c)}), true) AS n_distinct_le1 FROM features" for c in CATEGORICAL_FAULTS]
    return f"""cbase AS ({' UNION ALL '.join(parts)}),
catcounts AS (SELECT feature, value, count(*) AS cnt FROM catlong WHERE value IS NOT NULL GROUP BY feature, value),
modes AS (SELECT feature, arg_min(value, (-cnt, value)) AS mode FROM catcounts GROUP BY feature),
cstats AS (SELECT b.*, m.mode FROM cbase b LEFT JOIN modes m USING (feature)),
seps AS (
  SELECT feature, count(*) AS n_categories, bool_and(pure) AND count(*) > 1 AS is_separator
  FROM (SELECT feature, value, min({T}) = max({T}) AS pure FROM catlong
        WHERE value IS NOT NULL AND {T} IS NOT NULL GROUP BY feature, value) g
  GROUP BY feature
)"""


def _gov() -> str:
    return with_ctes(features_cte(), _nstats_cte(), _long_cat_cte(), _cstats_cte())


def _missing() -> str:
    cols = feature_columns()
    parts = [f"SELECT '{c}' AS feature, {i} AS position, count(*) - count({_qi(c)}) AS missing_count, "
             f"(count(*) - count({_qi(c)})) / count(*) AS missing_percentage, "
             f"'{'string' if c in CATEGORICAL_FAULTS else 'double'}' AS dtype FROM features" for i, c in enumerate(cols)]
    return with_ctes(features_cte()) + "\nSELECT feature, missing_count, round(missing_percentage, 6) AS missing_percentage, dtype, " + \
        "row_number() OVER (ORDER BY missing_count DESC, position) AS missing_rank FROM (" + \
        "\nUNION ALL ".join(parts) + ") m"


ORACLE["missing_profile"] = _missing()

ORACLE["numeric_profile"] = _gov() + """
SELECT feature, n, round(var_pop, 6) AS var_pop, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max,
       round(median, 6) AS median, round(corr_target, 6) AS corr_target FROM nstats"""

ORACLE["categorical_profile"] = _gov() + "\nSELECT feature, n, n_distinct_le1, mode FROM cstats"

ORACLE["separator_test"] = _gov() + "\nSELECT feature, n_categories, is_separator FROM seps"


def _name_leak_sql(col: str) -> str:
    t = T.lower()
    markers = " OR ".join(f"contains(lower(trim({col})), '{m}')" for m in K.LEAK_NAME_MARKERS)
    return f"(contains(lower(trim({col})), '{t}') AND ({markers}))"


def _cols_cte() -> str:
    vals = ", ".join(f"('{c}', {i})" for i, c in enumerate(feature_columns()))
    return f"cols AS (SELECT * FROM (VALUES {vals}) t(feature, position))"


ORACLE["leakage_audit"] = _gov() + f""", {_cols_cte()}
SELECT feature, 'name_overlap' AS rule, CAST(NULL AS DOUBLE) AS value,
       'Name similarity indicating target derivation: ''' || feature || ''' contains ''{T}''' AS reason
FROM cols WHERE {_name_leak_sql('feature')}
UNION ALL
SELECT feature, 'high_correlation', round(abs(corr_target), 6),
       'Absolute correlation score of ' || printf('%.5f', abs(corr_target)) || ' is >= threshold {K.LEAKAGE_CORRELATION}'
FROM nstats WHERE abs(corr_target) >= {K.LEAKAGE_CORRELATION}
UNION ALL
SELECT feature, 'deterministic_separator', NULL,
       'Perfect partition. Category values perfectly separate target state (post-facto metadata leak risk).'
FROM seps WHERE is_separator"""


def _decisions_cte() -> str:
    return f"""{_cols_cte()},
nrows AS (SELECT count(*) AS n_rows FROM features),
allstats AS (
  SELECT c.feature, c.position, coalesce(n.n, s.n) AS n, n.var_pop, n.median, n.corr_target,
         s.n_distinct_le1, s.mode, n.feature IS NOT NULL AS is_num, coalesce(p.is_separator, false) AS is_sep
  FROM cols c LEFT JOIN nstats n USING (feature) LEFT JOIN cstats s USING (feature) LEFT JOIN seps p USING (feature)
),
dec AS (
  SELECT a.*, (n_rows - n) / n_rows > {K.MISSING_THRESHOLD} AS drop_missing,
         {_name_leak_sql('feature')} AS r_name,
         is_num AND coalesce(abs(corr_target) >= {K.LEAKAGE_CORRELATION}, false) AS r_corr,
         NOT is_num AND is_sep AS r_sep,
         CASE WHEN is_num THEN var_pop IS NULL OR isnan(var_pop) OR var_pop <= {K.VARIANCE_THRESHOLD} ELSE n_distinct_le1 END AS low_var
  FROM allstats a, nrows
),
decided AS (
  SELECT *, CASE WHEN drop_missing THEN 'dropped' WHEN r_name OR r_corr OR r_sep THEN 'dropped'
                 WHEN low_var THEN 'dropped' ELSE 'kept' END AS decision,
         CASE WHEN drop_missing THEN 'missing_threshold'
              WHEN r_name OR r_corr OR r_sep THEN 'target_leakage:' || concat_ws(',', CASE WHEN r_name THEN 'name_overlap' END,
                   CASE WHEN r_corr THEN 'high_correlation' END, CASE WHEN r_sep THEN 'deterministic_separator' END)
              WHEN low_var THEN 'low_variance' WHEN is_num THEN 'numeric' ELSE 'categorical' END AS reason
  FROM dec
)"""


ORACLE["preprocess_report"] = _gov() + ", " + _decisions_cte() + """
SELECT feature, CAST(position AS BIGINT) AS position, decision, reason,
       CASE WHEN decision = 'kept' AND is_num THEN round(coalesce(median, 0.0), 6) END AS impute_numeric,
       CASE WHEN decision = 'kept' AND NOT is_num THEN coalesce(mode, 'UNKNOWN') END AS impute_text
FROM decided"""


def _feature_long() -> str:
    parts = [f"SELECT vec_id, '{c}' AS feature, CAST({_qi(c)} AS DOUBLE) AS num, NULL AS txt FROM features"
             for c in numeric_feature_columns()]
    parts += [f"SELECT vec_id, '{c}', NULL, {_qi(c)} FROM features" for c in CATEGORICAL_FAULTS]
    return "flong AS (" + "\nUNION ALL ".join(parts) + ")"


ORACLE["preprocessed_matrix"] = _gov() + ", " + _decisions_cte() + ", " + _feature_long() + """
SELECT f.vec_id, f.feature,
       CASE WHEN d.is_num THEN round(coalesce(CASE WHEN isnan(f.num) THEN NULL ELSE f.num END, coalesce(d.median, 0.0)), 6) END AS value_numeric,
       CASE WHEN NOT d.is_num THEN coalesce(CASE WHEN f.txt IN ('nan', 'None') THEN NULL ELSE f.txt END, coalesce(d.mode, 'UNKNOWN')) END AS value_text
FROM flong f JOIN decided d USING (feature) WHERE d.decision = 'kept'"""


def _collinear() -> str:
    cols = numeric_feature_columns()
    parts = [f"SELECT vec_id, '{c}' AS feature, {i} AS pos, CAST({_qi(c)} AS DOUBLE) AS v FROM features"
             for i, c in enumerate(cols)]
    return with_ctes(features_cte()) + ", lf AS (" + "\nUNION ALL ".join(parts) + f""")
SELECT col_i, col_j, round(c, 6) AS abs_corr FROM (
  SELECT a.feature AS col_i, b.feature AS col_j, abs(corr(a.v, b.v)) AS c
  FROM lf a JOIN lf b ON a.vec_id = b.vec_id AND a.pos < b.pos AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.feature, b.feature
) x WHERE c IS NOT NULL AND NOT isnan(c) AND c > {K.COLLINEAR_THRESHOLD}"""


ORACLE["collinear_pairs"] = _collinear()


# ---------------------------------------------------------------- milestone 4


def _labels() -> str:
    return _scored() + f", lab AS (SELECT seq, p, {T} AS y FROM scored)"


ORACLE["class_distribution"] = _labels() + """
SELECT CAST(y AS BIGINT) AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM lab), 6) AS fraction
FROM lab GROUP BY y"""

ORACLE["confusion_metrics"] = _labels() + """,
c AS (SELECT count(*) FILTER (WHERE y <> 1 AND p < 0.5) AS tn, count(*) FILTER (WHERE y <> 1 AND p >= 0.5) AS fp,
             count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp FROM lab),
d AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS prec,
                coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS rec FROM c)
SELECT tn, fp, fn, tp,
       round(coalesce((tp + tn) / nullif(CAST(tn + fp + fn + tp AS DOUBLE), 0), 0.0), 6) AS accuracy,
       round(prec, 6) AS precision, round(rec, 6) AS recall,
       round(CASE WHEN prec + rec > 0 THEN 2.0 * prec * rec / (prec + rec) ELSE 0.0 END, 6) AS f1,
       round(coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0.0) * 100, 6) AS fpr_pct,
       round(coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0.0) * 100, 6) AS tnr_pct,
       round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) * 100, 6) AS tpr_pct,
       round(coalesce(fn / nullif(CAST(fn + tp AS DOUBLE), 0), 0.0) * 100, 6) AS fnr_pct
FROM d"""


def _auc_sql(src: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""
counts AS (SELECT {g}p AS s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM {src} GROUP BY {g}p),
cum AS (
  SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before,
         coalesce(sum(pos) OVER ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above,
         coalesce(sum(neg) OVER ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_above
  FROM counts
),
auc AS (
  SELECT {g}sum(pos) AS n_pos, sum(neg) AS n_neg,
         CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (neg_before + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS roc_auc,
         CASE WHEN sum(pos) > 0 THEN coalesce(sum(CASE WHEN pos > 0 THEN pos * (pos_above + pos) / CAST(pos_above + pos + neg_above + neg AS DOUBLE) END), 0.0) / sum(pos) END AS pr_auc
  FROM cum {'GROUP BY ' + group if group else ''}
)"""


ORACLE["roc_pr_auc"] = _labels() + "," + _auc_sql("lab") + """
SELECT CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM auc"""


def _folds() -> str:
    return _labels() + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(seq AS VARCHAR) || '|42'), seq) AS class_rank,
         count(*) OVER (PARTITION BY y) AS n_class
  FROM lab
),
assigned AS (SELECT *, (class_rank - 1) % 5 AS fold, class_rank <= ceil(n_class * 0.2) AS is_test FROM ranked)"""


ORACLE["stratified_folds"] = _folds() + """
SELECT CAST(fold AS BIGINT) AS fold, CAST(y AS BIGINT) AS label, is_test, count(*) AS n FROM assigned GROUP BY ALL"""

ORACLE["cv_summary"] = _folds() + "," + _auc_sql("assigned", "fold") + """
SELECT round(avg(roc_auc), 6) AS cv_auc_mean, round(stddev_pop(roc_auc), 6) AS cv_auc_std, count(*) AS n_folds FROM auc"""


# ---------------------------------------------------------------- milestone 5


def _explained() -> str:
    feats = list(K.HIGHLIGHTED_FEATURES)
    data = {"F115", "F321", "F527", "F670"}
    n = len(feats)
    xs = {f: (f"coalesce(m_{f}, bg_{f})" if f in data else "CAST(0.0 AS DOUBLE)") for f in feats}

    def prob(over: dict) -> str:
        terms = [over[f] for f in feats]
        s = terms[0]
        for t in terms[1:]:
            s = f"({s} + {t})"
        return f"CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-({s} / CAST({float(n)} AS DOUBLE))))"

    bg = ", ".join(f"avg(m_{f}) AS bg_{f}" for f in sorted(data))
    xcols = ", ".join(f"{xs[f]} AS x_{f}" for f in feats)
    xref = {f: f"x_{f}" for f in feats}
    ssum = xref[feats[0]]
    for f in feats[1:]:
        ssum = f"({ssum} + {xref[f]})"
    margs = []
    for f in feats:
        mean = f"bgv_{f}" if f in data else "CAST(0.0 AS DOUBLE)"
        z = f"(({ssum} + CAST(1.0 AS DOUBLE) * ({mean} - x_{f})) / CAST({float(n)} AS DOUBLE))"
        margs.append(f"p - CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-{z})) AS mg_{f}")
    total = "mg_" + feats[0]
    for f in feats[1:]:
        total = f"({total} + mg_{f})"
    bgv = ", ".join(f"bg_{f} AS bgv_{f}" for f in sorted(data))
    attrs = " UNION ALL ".join(
        f"SELECT row_id, '{f}' AS feature, {i} AS position, "
        f"CASE WHEN abs(shift) < {K.ATTR_ZERO_SHIFT!r} THEN CAST(0.0 AS DOUBLE) "
        f"WHEN abs(total) > {K.ATTR_SCALE_MIN!r} THEN mg_{f} * (shift / total) "
        f"ELSE shift * CAST({1.0 / n!r} AS DOUBLE) END AS value, x_{f} AS raw_value, p FROM marg"
        for i, f in enumerate(feats))
    return with_ctes(transactions_cte()) + f""",
bgm AS (SELECT {bg} FROM transactions),
resolved AS (SELECT transaction_id AS row_id, {xcols} FROM transactions, bgm),
probs AS (SELECT *, {prob(xref)} AS p FROM resolved),
ev AS (SELECT avg(p) AS ev FROM probs),
marg0 AS (SELECT probs.*, p - ev AS shift, {bgv}, {', '.join(margs)} FROM probs, ev, bgm),
marg AS (SELECT *, {total} AS total FROM marg0),
attrs AS ({attrs})"""


def _z(x: str) -> str:
    return f"round({x}, 6) + CAST(0.0 AS DOUBLE)"


ORACLE["local_attributions"] = _explained() + f"""
SELECT row_id, feature, {_z('value')} AS value, {_z('raw_value')} AS raw_value FROM attrs"""

ORACLE["waterfall_steps"] = _explained() + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, position) AS rk,
                  count(*) OVER (PARTITION BY row_id) AS nf FROM attrs),
steps AS (
  SELECT row_id, rk AS step, feature, value, CASE WHEN value >= 0 THEN 'positive' ELSE 'negative' END AS type
  FROM ranked WHERE rk <= {K.WATERFALL_TOP_K}
  UNION ALL
  SELECT row_id, {K.WATERFALL_TOP_K + 1}, 'Other (' || CAST(max(nf) - {K.WATERFALL_TOP_K} AS VARCHAR) || ' marginal features)',
         sum(value), CASE WHEN sum(value) >= 0 THEN 'positive' ELSE 'negative' END
  FROM ranked WHERE rk > {K.WATERFALL_TOP_K} GROUP BY row_id
),
cum AS (SELECT s.*, (SELECT ev FROM ev) + sum(value) OVER (PARTITION BY row_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM steps s)
SELECT row_id, CAST(step AS BIGINT) AS step, feature, {_z('value')} AS value, {_z('cumulative')} AS cumulative, type FROM cum
UNION ALL
SELECT row_id, 0, '{K.BASE_STEP_LABEL}', CAST(0.0 AS DOUBLE), {_z('(SELECT ev FROM ev)')}, 'base' FROM probs
UNION ALL
SELECT row_id, {K.WATERFALL_TOP_K + 2}, '{K.FINAL_STEP_LABEL}', CAST(0.0 AS DOUBLE), {_z('p')}, 'total' FROM probs"""


def _importance() -> str:

    cat = ", ".join(f"('{k}', '{v}')" for k, v in K.FEATURE_DESCRIPTIONS.items())
    return _explained() + f""",
imp AS (SELECT feature, position, avg(abs(value)) AS score FROM attrs GROUP BY feature, position),
cat AS (SELECT * FROM (VALUES {cat}) t(feature, name))"""


ORACLE["global_importance"] = _importance() + f""",
top AS (SELECT * FROM imp ORDER BY round(score, 12) DESC, position LIMIT 15)
SELECT t.feature, {_z('t.score')} AS mean_abs_attribution, coalesce(c.name, 'Anonymized Feature ' || t.feature) AS name,
       'Model Feature' AS type, {_z('t.score / max(t.score) OVER () * 100.0')} AS relative_pct
FROM top t LEFT JOIN cat c ON c.feature = t.feature"""

ORACLE["beeswarm_points"] = _importance() + f""",
top AS (SELECT * FROM imp ORDER BY round(score, 12) DESC, position LIMIT 10),
pts AS (SELECT a.* FROM attrs a JOIN top USING (feature)),
st AS (SELECT feature, min(raw_value) AS vmin, max(raw_value) AS vmax FROM pts GROUP BY feature)
SELECT row_id, feature, {_z('raw_value')} AS val,
       {_z('CASE WHEN vmax - vmin > 0 THEN (raw_value - vmin) / (vmax - vmin) ELSE 0.5 END')} AS normalized_val,
       {_z('value')} AS shap_val
FROM pts JOIN st USING (feature)"""


# ---------------------------------------------------------------- milestone 6


def _digamma_sql(n: str) -> str:
    from ..operators.mutual_info import EULER_GAMMA, EXACT_DIGAMMA_MAX

    h = [0.0]
    for j in range(1, EXACT_DIGAMMA_MAX):
        h.append(h[-1] + 1.0 / j)
    cases = " ".join(f"WHEN {n} = {m} THEN CAST({(-EULER_GAMMA + h[m - 1])!r} AS DOUBLE)" for m in range(1, EXACT_DIGAMMA_MAX + 1))
    x = f"CAST({n} AS DOUBLE)"
    asym = (f"ln({x}) - CAST(0.5 AS DOUBLE) / {x} - CAST({1.0 / 12!r} AS DOUBLE) / ({x} * {x}) "
            f"+ CAST({1.0 / 120!r} AS DOUBLE) / pow({x}, 4) - CAST({1.0 / 252!r} AS DOUBLE) / pow({x}, 6)")
    return f"(CASE {cases} ELSE {asym} END)"


def _mean_psi(n: str) -> str:
    from ..operators.mutual_info import PSI_DIGITS

    return f"CAST(sum(CAST(round({_digamma_sql(n)}, {PSI_DIGITS}) AS DECIMAL(20,{PSI_DIGITS}))) AS DOUBLE) / count(*)"


def _mi() -> str:
    cols = numeric_feature_columns()
    lf = " UNION ALL ".join(
        f"SELECT CAST(vec_id AS VARCHAR) AS rid, CAST({T} AS INTEGER) AS y, '{c}' AS feature, {i} AS position, "
        f"CAST({_qi(c)} AS DOUBLE) AS x FROM features WHERE {_qi(c)} IS NOT NULL AND NOT isnan({_qi(c)}) AND {T} IS NOT NULL"
        for i, c in enumerate(cols))
    return with_ctes(features_cte()) + f""",
lf AS ({lf}),
p AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY feature, y) AS n_class FROM lf) t WHERE n_class > 1),
pairs AS (
  SELECT a.feature, a.rid, CASE WHEN b.x > a.x THEN b.x - a.x ELSE a.x - b.x END AS dist
  FROM p a JOIN p b ON a.feature = b.feature AND a.y = b.y AND a.rid <> b.rid
),
ranked_pairs AS (SELECT *, row_number() OVER (PARTITION BY feature, rid ORDER BY dist) AS rn FROM pairs),
kd AS (
  SELECT pt.feature, pt.position, pt.rid, pt.x, pt.n_class, least(3, pt.n_class - 1) AS k_i, r.dist AS d
  FROM p pt JOIN ranked_pairs r ON r.feature = pt.feature AND r.rid = pt.rid AND r.rn = least(3, pt.n_class - 1)
),
mm AS (
  SELECT kd.*, (SELECT count(*) FROM p o WHERE o.feature = kd.feature AND
                 ((kd.d > 0 AND o.x > kd.x - kd.d AND o.x < kd.x + kd.d) OR (kd.d = 0 AND o.x = kd.x))) AS m
  FROM kd
),
agg AS (
  SELECT feature, position, count(*) AS n, {_mean_psi('k_i')} AS psi_k, {_mean_psi('n_class')} AS psi_ny, {_mean_psi('m')} AS psi_m
  FROM mm GROUP BY feature, position
),
mi AS (SELECT feature, position, n, {_digamma_sql('n')} + psi_k - psi_ny - psi_m AS mi_raw FROM agg)"""


ORACLE["mutual_information"] = _mi() + """
SELECT feature, n, round(greatest(mi_raw, 0.0), 6) AS mi, round(mi_raw, 6) AS mi_raw FROM mi"""

ORACLE["mi_top_features"] = _mi() + """
SELECT feature, CAST(position AS BIGINT) AS position, CAST(mi_rank AS BIGINT) AS mi_rank, round(greatest(mi_raw, 0.0), 6) AS mi
FROM (SELECT *, row_number() OVER (ORDER BY round(greatest(mi_raw, 0.0), 9) DESC, position) AS mi_rank FROM mi) r
WHERE mi_rank <= 40"""


# ---------------------------------------------------------------- milestone 9 (streaming)

ORACLE["stream_alerts"] = _alerts() + """
SELECT risk_tier, severity, count(*) AS n_alerts, count(DISTINCT transaction_id) AS n_transactions,
       CAST(sum(risk_score) AS BIGINT) AS sum_score
FROM alerts GROUP BY risk_tier, severity"""

ORACLE["stream_telemetry"] = _scored() + """
SELECT strftime(time_bucket(INTERVAL '30 days', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS window_start,
       risk_tier, count(*) AS n, round(avg(final_risk_score), 6) AS avg_score
FROM scored GROUP BY ALL"""


# ---------------------------------------------------------------- sources and sinks

ORACLE["alert_snapshot_roundtrip"] = ORACLE["alert_workflow_state"]

ORACLE["risk_scores_csv_roundtrip"] = _scored() + f"""
, b AS (SELECT p * CAST(100.0 AS DOUBLE) AS ml, CAST({K.ML_WEIGHT} AS DOUBLE) * (p * CAST(100.0 AS DOUBLE)) + CAST({K.ANOMALY_WEIGHT} AS DOUBLE) * CAST(0.0 AS DOUBLE) AS fin FROM scored)
SELECT CASE WHEN fin >= 75 THEN 'Critical' WHEN fin >= 50 THEN 'High' WHEN fin >= 25 THEN 'Medium' ELSE 'Low' END AS band,
       count(*) AS n, round(avg(ml), 6) AS avg_ml_risk, round(avg(fin), 6) AS avg_final
FROM b GROUP BY 1"""


def _csv_missing() -> str:
    cols = feature_columns()
    parts = [f"SELECT '{c}' AS feature, count(*) - count({_qi(c)}) AS missing_count, "
             f"round((count(*) - count({_qi(c)})) / count(*), 6) AS missing_percentage FROM features" for c in cols]
    return with_ctes(features_cte()) + "\n" + "\nUNION ALL ".join(parts)


ORACLE["feature_csv_scan"] = _csv_missing()

ORACLE["stream_workflow_state"] = ORACLE["alert_workflow_state"]

ORACLE["recent_quarter_tiers"] = _scored() + """
SELECT risk_tier, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts
FROM scored WHERE ts >= (SELECT max(ts) FROM scored) - INTERVAL 90 DAYS GROUP BY risk_tier"""


def _wide_attributions() -> str:
    """Perturbation attributions of the 70-feature linear model, written out per feature."""
    names = [f"F{i}" for i in range(64)] + [f"S{g}" for g in range(6)]
    weights = [((i * 7) % 11 - 5) / 10.0 for i in range(70)]
    sums = ", ".join("(" + " + ".join(f"F{10 * g + i}" for i in range(10)) + f") AS S{g}" for g in range(6))
    z = "CAST(-0.5 AS DOUBLE) + " + " + ".join(f"CAST({w!r} AS DOUBLE) * {n}" for n, w in zip(names, weights))
    total = sum(abs(w) for w in weights)
    rows = " UNION ALL ".join(
        f"SELECT vec_id, '{n}' AS feature, {i} AS position, {n} AS x, CAST({w!r} AS DOUBLE) AS w, CAST({abs(w) / total!r} AS DOUBLE) AS imp, z, p FROM scored_w"
        for i, (n, w) in enumerate(zip(names, weights)))
    return with_ctes(features_cte()) + f""",
wide AS (SELECT vec_id, {", ".join(f"F{i}" for i in range(64))}, {sums} FROM features),
scored_w AS (SELECT *, 1.0 / (1.0 + exp(-z)) AS p FROM (SELECT *, {z} AS z FROM wide) s),
long AS ({rows}),
means AS (SELECT feature, avg(x) AS mean FROM long GROUP BY feature),
ev AS (SELECT avg(p) AS ev FROM scored_w),
marg AS (SELECT l.*, CASE WHEN w = 0 THEN 0.0 ELSE p - 1.0 / (1.0 + exp(-(z + w * (mean - x)))) END AS m, p - ev AS shift
         FROM long l JOIN means USING (feature), ev),
tot AS (SELECT vec_id, sum(m) AS total FROM marg GROUP BY vec_id),
attr AS (SELECT feature, position, CASE WHEN abs(shift) < {K.ATTR_ZERO_SHIFT} THEN 0.0
                WHEN abs(total) > {K.ATTR_SCALE_MIN} THEN m * (shift / total) ELSE shift * imp END AS value
         FROM marg JOIN tot USING (vec_id))
SELECT feature, CAST(position AS BIGINT) AS position, {_z('avg(abs(value))')} AS mean_abs_attribution FROM attr GROUP BY feature, position"""


ORACLE["wide_attributions"] = _wide_attributions()


def _hash_fraction(key: str) -> str:
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE))"


def _minority() -> str:
    return f"""
sizes AS (SELECT {T} AS y, count(*) AS n FROM features GROUP BY {T}),
mino AS (SELECT arg_min(y, (n, y)) AS y, min(n) AS n_min, max(n) AS n_maj FROM sizes),
numbered AS (SELECT f.*, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id) AS pick FROM features f, mino WHERE f.{T} = mino.y)"""


ORACLE["oversampled_classes"] = with_ctes(features_cte(), _minority()) + f""",
drawn AS (SELECT CAST(floor({_hash_fraction("CAST(d.range AS VARCHAR) || '|42'")} * n_min) + 1 AS BIGINT) AS pick FROM mino, range((SELECT n_maj FROM mino)) d)
SELECT vec_id, CAST({T} AS BIGINT) AS label, count(*) AS n FROM drawn JOIN numbered USING (pick) GROUP BY ALL
UNION ALL SELECT vec_id, CAST({T} AS BIGINT), 1 FROM features, mino WHERE {T} <> mino.y"""


def _smote() -> str:
    dims = ", ".join(f"F{i}" for i in range(64))
    return with_ctes(features_cte(), _minority()) + f""",
pts AS (SELECT pick, vec_id, [{dims}] AS v FROM numbered),
pairs AS (SELECT a.pick AS i, b.pick AS j, sqrt(list_sum(list_transform(range(1, 65), lambda d: (a.v[d] - b.v[d]) * (a.v[d] - b.v[d])))) AS dist
          FROM pts a JOIN pts b ON a.pick <> b.pick),
nn AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM pairs),
drawn AS (
  SELECT d.range AS draw, CAST(floor({_hash_fraction("CAST(d.range AS VARCHAR) || '|42'")} * n_min) + 1 AS BIGINT) AS i,
         CAST(floor({_hash_fraction("CAST(d.range AS VARCHAR) || '|43'")} * least(3, n_min - 1)) + 1 AS BIGINT) AS rank,
         {_hash_fraction("CAST(d.range AS VARCHAR) || '|44'")} AS u
  FROM mino, range((SELECT n_maj - n_min FROM mino)) d)
SELECT draw, a.vec_id, b.vec_id AS neighbour, round(u, 6) AS u,
       round(list_sum(list_transform(range(1, 65), lambda d: a.v[d] + u * (b.v[d] - a.v[d]))), 5) AS sum_x
FROM drawn JOIN nn USING (i, rank) JOIN pts a ON a.pick = i JOIN pts b ON b.pick = j"""


ORACLE["smote_rows"] = _smote()


def _training_split() -> str:
    """The governance decisions over the training rows alone, then their medians."""
    split = f"""all_rows AS (SELECT * FROM features_all),
ranked_rows AS (SELECT *, row_number() OVER (PARTITION BY {T} ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id) AS class_rank,
                       count(*) OVER (PARTITION BY {T}) AS n_class FROM all_rows),
features AS (SELECT * EXCLUDE (class_rank, n_class) FROM ranked_rows WHERE class_rank > ceil(n_class * 0.2)),
held AS (SELECT * FROM ranked_rows WHERE class_rank <= ceil(n_class * 0.2))"""
    every = features_cte().replace("\nfeatures AS (", "\nfeatures_all AS (")
    decisions = _decisions_cte().replace(f"abs(corr_target) >= {K.LEAKAGE_CORRELATION}", f"abs(corr_target) >= {K.TRAINING_LEAKAGE_CORRELATION}")
    return with_ctes(every, split, _nstats_cte(), _long_cat_cte(), _cstats_cte()) + ", " + decisions + f"""
SELECT feature, round(coalesce(median, 0.0), 6) AS median,
       (SELECT count(*) FROM features WHERE {T} = 0) AS n_train_0, (SELECT count(*) FROM features WHERE {T} = 1) AS n_train_1,
       (SELECT count(*) FROM held WHERE {T} = 0) AS n_test_0, (SELECT count(*) FROM held WHERE {T} = 1) AS n_test_1
FROM decided WHERE decision = 'kept' AND is_num"""


ORACLE["training_split"] = _training_split()

ORACLE["smote_classes"] = with_ctes(features_cte()) + f""",
kept AS (SELECT {T} AS y, count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) AS n FROM features GROUP BY {T})
SELECT CAST(y AS BIGINT) AS label, (SELECT max(n) FROM kept) AS n FROM kept"""


# ---------------------------------------------------------------- store paths, filters, exports

ORACLE["alerts_against_store"] = _alerts() + """,
store AS (SELECT transaction_id FROM alerts WHERE seq % 2 = 0)
SELECT 'new' AS kind, count(*) AS n, CAST(sum(seq) AS BIGINT) AS sum_seq FROM alerts WHERE transaction_id NOT IN (SELECT transaction_id FROM store)
UNION ALL
SELECT 'existing', count(*), CAST(sum(seq) AS BIGINT) FROM scored WHERE transaction_id IN (SELECT transaction_id FROM store)"""

ORACLE["backfill_into_store"] = _backfill().rsplit("SELECT printf('ALT-DS", 1)[0] + """, al AS (
  SELECT 'Open' AS status, final_risk_score AS risk_score FROM scored WHERE final_risk_score > 25 AND seq % 10 > 1)
SELECT true AS backfilled, CASE WHEN (n - 1) % 2 = 1 THEN 'Closed' ELSE 'Open' END AS status, count(*) AS n, CAST(sum(score) AS BIGINT) AS sum_score FROM sample GROUP BY ALL
UNION ALL SELECT false, status, count(*), CAST(sum(risk_score) AS BIGINT) FROM al GROUP BY status"""

ORACLE["score_range_by_source"] = _view() + """,
r AS (SELECT * FROM view WHERE risk_score BETWEEN 60 AND 89)
SELECT 'live-all' AS source, status, count(*) AS n FROM r GROUP BY status
UNION ALL SELECT 'live-target', status, count(*) FROM r WHERE starts_with(id, 'ALT-TGT-') OR type = 'Mule Account' GROUP BY status
UNION ALL SELECT 'live-dataset', status, count(*) FROM r WHERE starts_with(id, 'ALT-DS-') GROUP BY status"""

_FLAT = [(f"F{i}", (i - 3) / 2.0) for i in range(8)]

ORACLE["direct_predictions"] = with_ctes(features_cte()) + """
SELECT vec_id, round(p, 6) AS fraud_probability, CAST(p >= 0.5 AS BIGINT) AS label
FROM (SELECT vec_id, 1.0 / (1.0 + exp(-(CAST(0.25 AS DOUBLE) + """ + " + ".join(
    f"CAST({w!r} AS DOUBLE) * " + (f"CASE WHEN vec_id % 3 > 0 THEN {f} ELSE CAST(0.0 AS DOUBLE) END" if f == "F7" else f) for f, w in _FLAT) + """))) AS p FROM features) x"""

ORACLE["linear_proxy"] = with_ctes(features_cte()) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg(abs(({f} - CAST(0.01 AS DOUBLE)) * CAST({abs(w) / sum(abs(x) for _, x in _FLAT)!r} AS DOUBLE))), 6) AS mean_abs FROM features" for f, w in _FLAT)

ORACLE["selected_matrix"] = with_ctes(features_cte()) + """
SELECT vec_id, round(F3, 6) AS F3, CAST(0.0 AS DOUBLE) AS F_missing, round(F1, 6) AS F1 FROM features"""

ORACLE["scorecard_records"] = _scored() + """
SELECT transaction_id, ml_score AS base_ml_score, CAST(final_risk_score AS BIGINT) AS final_risk_score, risk_tier, action_decision,
       CAST(triggered_rules_count AS BIGINT) AS n_overrides FROM scored"""


def _anomaly_blend() -> str:
    """The scorecard CTE with the given anomaly score blended in and rule U04 beside the others."""
    sql = with_ctes(transactions_cte(), scored_cte())
    risk = "greatest(CAST(0.0 AS DOUBLE), least(CAST(100.0 AS DOUBLE), (CAST(0.5 AS DOUBLE) - anomaly_score) / CAST(1.0 AS DOUBLE) * CAST(100.0 AS DOUBLE)))"
    sql = sql.replace("  SELECT t.*,\n", "  SELECT t.*, (seq * 7 % 101) / CAST(100.0 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS anomaly_score, seq % 20 = 0 AS hit_u04,\n")
    sql = sql.replace(f"CAST({K.ANOMALY_WEIGHT} AS DOUBLE) * CAST(0.0 AS DOUBLE)", f"CAST({K.ANOMALY_WEIGHT} AS DOUBLE) * {risk}")
    a03 = K.RULE_SCORES[K.RULE_A03_ID][0]
    sql = sql.replace(f"CASE WHEN hit_a03 THEN {a03} END) AS top_rule_score", f"CASE WHEN hit_a03 THEN {a03} END, CASE WHEN hit_u04 THEN {K.RULE_SCORES[K.RULE_U04_ID][0]} END) AS top_rule_score")
    return sql + f"""
SELECT risk_tier, hit_u04 AS is_unsupervised_outlier, count(*) AS n, round(avg({risk}), 6) AS avg_anomaly_risk, CAST(sum(final_risk_score) AS BIGINT) AS sum_score
FROM scored GROUP BY ALL"""


ORACLE["anomaly_blend"] = _anomaly_blend()

ORACLE["report_exports"] = _view() + """
SELECT 'explorer' AS report, CAST(5 AS BIGINT) AS n_columns, count(*) AS n, CAST(sum(risk_score) AS BIGINT) AS sum_score FROM view
UNION ALL SELECT 'outliers', 4, count(*), CAST(sum(risk_score) AS BIGINT) FROM view WHERE risk_score >= 50"""

ORACLE["preprocessor_roundtrip"] = ORACLE["preprocessed_matrix"]


# ---------------------------------------------------------------- trees with random thresholds

from ..operators.isolation import EULER  # noqa: E402
from .catalog import FOREST_DEPTH, FOREST_TREES  # noqa: E402

_VECTOR = "[" + ", ".join(f"F{i}" for i in range(64)) + "]"


def _random_levels(depth: int, candidates: int, min_split: int, by_class: bool) -> str:
    """Levels of the trees over ``m0`` (tree, node, x, y): ``s<d>`` their splits, ``m<d>`` the rows that are still in a node."""
    draw = "CAST(('0x' || substr(md5('42|' || tree || '|' || node || '|' || f || '|at'), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE)"
    out = []
    for d in range(depth):
        mixed = "AND sum(y) > 0 AND sum(y) < count(*)" if by_class else ""
        out.append(f"""c{d} AS MATERIALIZED (
  SELECT tree, node, f, n, p, lo + {draw} * (hi - lo) AS thr,
         row_number() OVER (PARTITION BY tree, node ORDER BY md5('42|' || tree || '|' || node || '|' || f)) AS place
  FROM (SELECT tree, node, f - 1 AS f, count(*) AS n, sum(y) AS p, min(x[f]) AS lo, max(x[f]) AS hi FROM m{d}, range(1, 65) r(f)
        GROUP BY ALL HAVING count(*) >= {min_split} {mixed} AND min(x[f]) < max(x[f])) s
  QUALIFY place <= {candidates})""")
        if by_class:
            out.append(f"""s{d} AS MATERIALIZED (
  SELECT tree, node, f, thr FROM (
    SELECT c.tree, c.node, c.f, c.thr, c.place, c.n, c.p, count(*) FILTER (x[c.f + 1] < c.thr) AS nl, coalesce(sum(y) FILTER (x[c.f + 1] < c.thr), 0) AS pl
    FROM m{d} m JOIN c{d} c ON c.tree = m.tree AND c.node = m.node GROUP BY ALL) t
  WHERE nl > 0 AND nl < n
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY CAST(pl * (nl - pl) AS DOUBLE) / nl + CAST((p - pl) * (n - nl - p + pl) AS DOUBLE) / (n - nl), place) = 1)""")
        else:
            out.append(f"s{d} AS (SELECT tree, node, f, thr FROM c{d})")
        out.append(f"m{d + 1} AS MATERIALIZED (SELECT m.tree, m.node * 2 + CASE WHEN m.x[s.f + 1] < s.thr THEN 0 ELSE 1 END AS node, m.x, m.y FROM m{d} m JOIN s{d} s ON s.tree = m.tree AND s.node = m.node)")
    out.append("splits AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(depth)) + ")")
    out.append("held AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT tree, node, y FROM m{d}" for d in range(depth + 1)) + ")")
    out.append("leaves AS MATERIALIZED (SELECT tree, node, count(*) AS n, sum(y) AS p FROM held h WHERE NOT EXISTS (FROM splits s WHERE s.tree = h.tree AND s.node = h.node) GROUP BY ALL)")
    return ",\n".join(out)


ORACLE["extra_trees_splits"] = with_ctes(features_cte(), f"m0 AS MATERIALIZED (SELECT t.range AS tree, 1 AS node, {_VECTOR} AS x, {T} AS y FROM features, range({FOREST_TREES}) t)",
                                         _random_levels(FOREST_DEPTH, 8, 5, True)) + """
SELECT tree, CAST(node AS BIGINT) AS node, CAST(f AS BIGINT) AS feature, round(thr, 6) AS threshold, CAST(0.0 AS DOUBLE) AS value FROM splits
UNION ALL SELECT tree, CAST(node AS BIGINT), -1, 0.0, round(p / CAST(n AS DOUBLE), 6) FROM leaves"""

ORACLE["isolation_forest"] = with_ctes(features_cte(), f"""pts AS (SELECT vec_id, {_VECTOR} AS x FROM features),
m0 AS MATERIALIZED (SELECT t.range AS tree, 1 AS node, x, 0 AS y FROM pts, range(100) t
       QUALIFY row_number() OVER (PARTITION BY t.range ORDER BY md5(vec_id || '|' || t.range || '|42'), vec_id) <= 256)""",
                                       _random_levels(8, 1, 2, False)) + f""",
walk0 AS MATERIALIZED (SELECT vec_id, x, t.range AS tree, 1 AS node FROM pts, range(100) t),
""" + ",\n".join(f"""walk{d + 1} AS MATERIALIZED (SELECT w.vec_id, w.x, w.tree, CASE WHEN s.f IS NULL THEN w.node WHEN w.x[s.f + 1] < s.thr THEN w.node * 2 ELSE w.node * 2 + 1 END AS node
  FROM walk{d} w LEFT JOIN s{d} s ON s.tree = w.tree AND s.node = w.node)""" for d in range(8)) + f""",
size AS (SELECT least(256, count(*)) AS psi FROM pts),
paths AS (SELECT vec_id, avg(floor(log2(l.node) + CAST(1e-9 AS DOUBLE)) + CASE WHEN l.n <= 1 THEN 0 WHEN l.n = 2 THEN 1 ELSE 2 * (ln(l.n - 1) + CAST({EULER} AS DOUBLE)) - 2 * (l.n - 1) / CAST(l.n AS DOUBLE) END) AS h
          FROM walk8 w JOIN leaves l ON l.tree = w.tree AND l.node = w.node GROUP BY vec_id),
scores AS (SELECT vec_id, -pow(CAST(2.0 AS DOUBLE), -h / (2 * (ln(psi - 1) + CAST({EULER} AS DOUBLE)) - 2 * (psi - 1) / CAST(psi AS DOUBLE))) AS score FROM paths, size),
cut AS (SELECT quantile_disc(score, 0.018) AS c FROM scores),
decisions AS (SELECT vec_id, score, score - c AS decision FROM scores, cut)
SELECT vec_id, round(score, 6) AS score, round(decision, 6) AS decision, CAST(CASE WHEN decision < 0 THEN -1 ELSE 1 END AS BIGINT) AS anomaly_label,
       round(min(decision) OVER (), 6) AS least, round(max(decision) OVER (), 6) AS most FROM decisions"""


# ---------------------------------------------------------------- boosted trees

from ..operators import boosting as BO  # noqa: E402


def _boosted(s: BO.Settings) -> str:
    """All gainful splits of the first tree down to the settings' depth (``sp``), and every node's sums (``nd``)."""
    cols = BO.columns_of(0, 64, s.columns, s.seed)
    start = "(SELECT ln(avg(y) / (1 - avg(y))) FROM pts)" if s.from_mean else "CAST(0.0 AS DOUBLE)"
    mixed = "(CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8)) AS HUGEINT) * 2654435761) % 4294967296"
    taken = f"""SELECT vec_id, CAST(xor(v, v >> 13) AS DOUBLE) / 4294967296.0 AS share FROM (
  SELECT vec_id, CAST((CAST(xor(v, v >> 15) AS HUGEINT) * 2246822519) % 4294967296 AS BIGINT) AS v FROM (SELECT vec_id, CAST({mixed} AS BIGINT) AS v FROM features) a) b"""
    out = [f"pts AS (SELECT vec_id, CAST({T} AS DOUBLE) AS y, {_VECTOR} AS x FROM features)",
           "longs AS (SELECT f - 1 AS f, x[f] AS v FROM pts, range(1, 65) r(f))",
           f"cuts AS MATERIALIZED (SELECT f, list_sort(list_distinct(quantile_disc(v, [{', '.join(repr(i / s.bins) for i in range(1, s.bins))}]))) AS c FROM longs WHERE f IN ({', '.join(map(str, cols))}) GROUP BY f)",
           f"taken AS ({taken})",
           f"probs AS (SELECT vec_id, 1 / (1 + exp(-{start})) AS p FROM pts)",
           f"""grads AS (SELECT vec_id, x, round_even((p - y) * w * {BO.UNIT}, 0) AS g, round_even(p * (1 - p) * w * {BO.UNIT}, 0) AS h
  FROM (SELECT pts.vec_id, x, y, p, CASE WHEN y = 1 THEN CAST({s.positive_weight} AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS w
        FROM pts JOIN probs USING (vec_id) JOIN taken USING (vec_id) WHERE share < CAST({s.rows} AS DOUBLE)) a)""",
           f"r0 AS MATERIALIZED (SELECT 1 AS node, g, h, x FROM grads)"]
    u = repr(BO.UNIT)
    for d in range(s.depth):
        out.append(f"""b{d} AS MATERIALIZED (SELECT node, f, len(list_filter(c, lambda e: e <= x[f + 1])) AS bin, count(*) AS n, sum(g) AS g, sum(h) AS h FROM r{d}, cuts GROUP BY ALL)""")
        out.append(f"""e{d} AS MATERIALIZED (
  SELECT b.node, b.f, k.range AS cut, sum(b.n) FILTER (b.bin <= k.range) AS nl, sum(b.g) FILTER (b.bin <= k.range) AS gl, sum(b.h) FILTER (b.bin <= k.range) AS hl,
         sum(b.n) AS n, sum(b.g) AS g, sum(b.h) AS h FROM b{d} b, range({s.bins - 1}) k GROUP BY ALL)""")
        out.append(f"""sp{d} AS MATERIALIZED (
  SELECT * FROM (SELECT *, (gl / {u}) * (gl / {u}) / (hl / {u} + {s.ridge}) + ((g - gl) / {u}) * ((g - gl) / {u}) / ((h - hl) / {u} + {s.ridge}) - (g / {u}) * (g / {u}) / (h / {u} + {s.ridge}) AS gain FROM e{d}
                 WHERE nl >= {s.least_rows} AND n - nl >= {s.least_rows} AND hl / {u} >= {s.least_hessian} AND (h - hl) / {u} >= {s.least_hessian}) q
  WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) = 1)""")
        out.append(f"""r{d + 1} AS MATERIALIZED (SELECT r.node * 2 + CASE WHEN x[s.f + 1] < c.c[s.cut + 1] THEN 0 ELSE 1 END AS node, r.g, r.h, r.x
  FROM r{d} r JOIN sp{d} s ON s.node = r.node JOIN cuts c ON c.f = s.f)""")
    out.append("sp AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT s.*, c.c[s.cut + 1] AS thr FROM sp{d} s JOIN cuts c ON c.f = s.f" for d in range(s.depth)) + ")")
    out.append("nd AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT node, count(*) AS n, sum(g) / {u} AS g, sum(h) / {u} AS h FROM r{d} GROUP BY node" for d in range(s.depth + 1)) + ")")
    return ",\n".join(out)


def _node_rows(s: BO.Settings, place: str) -> str:
    return f"""SELECT CAST(n.node AS BIGINT) AS node, {place} CAST(coalesce(s.f, -1) AS BIGINT) AS feature, round(coalesce(s.thr, 0.0), 5) AS threshold, round(coalesce(s.gain, 0.0), 5) AS gain,
       CAST(n.n AS BIGINT) AS n, round(n.g, 5) AS g, round(n.h, 5) AS h, round(CASE WHEN s.node IS NULL THEN -n.g / (n.h + {s.ridge}) * {s.rate} ELSE 0.0 END, 5) AS value"""


ORACLE["boosted_tree"] = with_ctes(features_cte(), _boosted(BO.BOOSTED_WEIGHTED)) + "\n" + _node_rows(BO.BOOSTED_WEIGHTED, "") + " FROM nd n LEFT JOIN sp s ON s.node = n.node"

ORACLE["leaf_wise_tree"] = "WITH RECURSIVE" + with_ctes(features_cte(), _boosted(BO.LEAF_WISE)).strip()[4:] + f""",
every AS (SELECT list({{'gain': gain, 'last': -node}}) AS splits FROM sp),
steps AS (SELECT 0 AS place, 0 AS node, list_filter(splits, lambda e: e.last = -1) AS open, splits FROM every
  UNION ALL
  SELECT place + 1, -best.last, list_concat(list_filter(open, lambda e: e.last <> best.last), list_filter(splits, lambda e: e.last IN (2 * best.last, 2 * best.last - 1))), splits
  FROM (SELECT *, list_max(open) AS best FROM steps WHERE len(open) > 0 AND place < {BO.LEAF_WISE.leaves} - 1) q),
chosen AS (SELECT s.*, t.place FROM sp s JOIN steps t ON t.node = s.node)
""" + _node_rows(BO.LEAF_WISE, "CAST(coalesce(s.place, 0) AS BIGINT) AS place,") + """
FROM nd n LEFT JOIN chosen s ON s.node = n.node WHERE n.node = 1 OR n.node // 2 IN (SELECT node FROM chosen)"""

ORACLE["elimination_rounds"] = with_ctes(features_cte(), f"""gaps AS (SELECT f - 1 AS f, round(abs(avg(x[f]) FILTER (y = 1) - avg(x[f]) FILTER (y = 0)), 9) AS w
  FROM (SELECT {_VECTOR} AS x, {T} AS y FROM features) p, range(1, 65) r(f) GROUP BY f),
placed AS (SELECT *, row_number() OVER (ORDER BY w, f) - 1 AS place FROM gaps)""") + f"""
SELECT 'F' || f AS feature, round(w, 6) AS weight,
       CAST(CASE WHEN place >= 64 - {K.RFE_MIN_FEATURES} THEN 0 ELSE 1 + place // greatest(1, CAST(floor({K.RFE_STEP} * 64) AS INTEGER)) END AS BIGINT) AS dropped_in FROM placed"""


# ---------------------------------------------------------------- Shapley values of any model

from .catalog import SHAPLEY_PAIRS  # noqa: E402

_P8 = "1 / (1 + exp(-(CAST(0.25 AS DOUBLE) + " + " + ".join(f"CAST({w!r} AS DOUBLE) * CASE WHEN {{has}} THEN x[{i + 1}] ELSE b[{i + 1}] END".replace("{has}", f"({{set}} >> {i}) & 1 = 1") for i, (_, w) in enumerate(_FLAT)) + ")))"
_SHAPLEY = with_ctes(features_cte(), f"""base AS (SELECT [{", ".join(f"avg({f})" for f, _ in _FLAT)}] AS b FROM features),
sets AS MATERIALIZED (SELECT vec_id, m.range AS m, {_P8.replace("{set}", "m.range")} AS p FROM (SELECT vec_id, [{", ".join(f for f, _ in _FLAT)}] AS x FROM features) v, base, range(256) m)""")

ORACLE["shapley_exact"] = _SHAPLEY + """
SELECT a.vec_id, 'F' || f.range AS feature, round(sum((b.p - a.p) * factorial(bit_count(a.m)) * factorial(7 - bit_count(a.m)) / factorial(8)), 6) AS shap
FROM range(8) f, sets a JOIN sets b ON b.vec_id = a.vec_id AND b.m = a.m + (1 << f.range) WHERE (a.m >> f.range) & 1 = 0 GROUP BY ALL"""

ORACLE["shapley_sampled"] = _SHAPLEY + f""",
places AS (SELECT r.range AS r, f.range AS f, row_number() OVER (PARTITION BY r.range ORDER BY md5('42|' || r.range || '|' || f.range)) - 1 AS place FROM range({SHAPLEY_PAIRS}) r, range(8) f),
orders AS (SELECT 2 * r AS o, f, place FROM places UNION ALL SELECT 2 * r + 1, f, 7 - place FROM places),
turns AS (SELECT a.o, a.f, CAST(coalesce(sum(1 << b.f), 0) AS BIGINT) AS before FROM orders a LEFT JOIN orders b ON b.o = a.o AND b.place < a.place GROUP BY ALL)
SELECT a.vec_id, 'F' || t.f AS feature, round(avg(b.p - a.p), 6) AS shap
FROM turns t JOIN sets a ON a.m = t.before JOIN sets b ON b.vec_id = a.vec_id AND b.m = t.before + (1 << t.f) GROUP BY ALL"""

ORACLE["stream_keyed_state"] = ORACLE["stream_workflow_state"]

ORACLE["ml_pipeline_matrix"] = ORACLE["preprocessed_matrix"]

ORACLE["alert_store_versions"] = _workflow() + """
SELECT 'seed' AS version, status, count(*) AS n FROM alerts WHERE seq % 100 = 0 GROUP BY status
UNION ALL SELECT 'opened', status, count(*) FROM alerts GROUP BY status
UNION ALL SELECT 'updated', status, count(*) FROM after GROUP BY status"""


# ---------------------------------------------------------------- audits, records and exports

ORACLE["preprocess_audit"] = f"""WITH r AS ({ORACLE["preprocess_report"]}),
s AS (SELECT unnest(list_distinct([split_part(reason, ':', 1), 'input', CASE WHEN decision = 'kept' THEN 'output' ELSE 'input' END])) AS section, feature, position FROM r),
names(section) AS (VALUES ('missing_threshold'), ('target_leakage'), ('low_variance'), ('numeric'), ('categorical'), ('input'), ('output'))
SELECT n.section, count(s.feature) AS n, coalesce(string_agg(s.feature, ',' ORDER BY s.position), '') AS features FROM names n LEFT JOIN s ON s.section = n.section GROUP BY n.section"""

ORACLE["selection_audit"] = f"""WITH p AS ({ORACLE["collinear_pairs"]}), m AS ({ORACLE["mi_top_features"]}), gone AS (SELECT DISTINCT col_j FROM p)
SELECT 'collinear_dropped' AS section, count(*) AS n, coalesce(string_agg(col_j, ',' ORDER BY col_j), '') AS features FROM gone
UNION ALL SELECT 'top_mutual_information', count(*), string_agg(feature, ',' ORDER BY mi_rank) FROM m WHERE mi_rank <= 15
UNION ALL SELECT 'retained', count(*), string_agg(feature, ',' ORDER BY mi_rank) FROM m WHERE feature NOT IN (SELECT col_j FROM gone)"""

ORACLE["forced_features"] = with_ctes(features_cte()) + "\n" + "\nUNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{f}' AS feature, round(sum({c}), 6) AS sum_value FROM features"
    for i, (f, c) in enumerate([("F4", "F4"), ("F115", "F61"), ("F2", "F2"), ("F670", "F60"), ("F3894", "F62")]))

_ACTIVE = [("XGBoost_classifier", "xgboost", 1), ("Random Forest", "randomforest", 2), (" logisticregression", "logisticregression", 0), ("no such model", "xgboost", 1)]
ORACLE["active_models"] = with_ctes(features_cte()) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{r}' AS request, '{n}' AS model, round(avg(1 / (1 + exp(-(CAST({0.1 * i} AS DOUBLE) + CAST({1.0 + i} AS DOUBLE) * F0 + CAST({-0.5 * i} AS DOUBLE) * F1)))), 6) AS mean_probability FROM features"
    for r, n, i in _ACTIVE) + f"\nUNION ALL SELECT 'any', 'none', CAST({K.PREDICTION_FALLBACK} AS DOUBLE)"

ORACLE["anomaly_record"] = f"""WITH a AS ({ORACLE["isolation_forest"]}), y AS ({with_ctes(features_cte())} SELECT vec_id, {T} AS y FROM features),
c AS (SELECT count(*) FILTER (y <> 1 AND anomaly_label = 1) AS tn, count(*) FILTER (y <> 1 AND anomaly_label = -1) AS fp,
             count(*) FILTER (y = 1 AND anomaly_label = 1) AS fn, count(*) FILTER (y = 1 AND anomaly_label = -1) AS tp FROM a JOIN y USING (vec_id)),
d AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS prec, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS rec FROM c)
SELECT 'isolationforest' AS model, round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall,
       round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0), 6) AS f1, CAST(0.5 AS DOUBLE) AS roc_auc, CAST(0.0 AS DOUBLE) AS pr_auc, tn, fp, fn, tp FROM d"""

ORACLE["tree_importance"] = with_ctes(features_cte(), _boosted(BO.BOOSTED)) + """,
w AS (SELECT f, sum(gain) / (SELECT sum(gain) FROM sp) AS weight FROM sp GROUP BY f)
SELECT 'F' || f AS feature, round(weight, 6) AS weight, round(avg(abs((v - CAST(0.01 AS DOUBLE)) * weight)), 6) AS mean_abs FROM w JOIN longs USING (f) GROUP BY f, weight"""

ORACLE["metrics_report"] = f"""WITH m AS ({ORACLE["confusion_metrics"]})
SELECT 'proxy' AS model, round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE) * 100, 2) AS accuracy_pct, round(fp / CAST(greatest(fp + tn, 1) AS DOUBLE) * 100, 2) AS fpr_pct, round(recall * 100, 2) AS recall_pct, round(f1, 4) AS f1 FROM m"""

ORACLE["top_driver_report"] = f"""WITH g AS ({ORACLE["global_importance"]}), l AS ({ORACLE["local_attributions"]}),
top AS (SELECT * FROM g ORDER BY mean_abs_attribution DESC LIMIT 4)
SELECT t.feature, t.name, CASE WHEN l.value > 0 THEN 'Risk Increasing' ELSE 'Risk Reducing' END AS type, l.value AS shap_value, printf('%.2f', l.raw_value) AS value, t.mean_abs_attribution AS score
FROM top t JOIN l ON l.feature = t.feature AND l.row_id = 'TXN-1'"""


def _compact(c: str) -> str:
    return f"'$' || CASE WHEN {c} >= 1000000 THEN printf('%.2f', {c} / 1000000) || 'M' WHEN {c} >= 1000 THEN printf('%.1f', {c} / 1000) || 'k' ELSE printf('%.0f', {c}) END"


ORACLE["sanctioned_origins"] = with_ctes(transactions_cte()) + f""",
s AS (SELECT origin_country, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(20, 2))) AS DOUBLE) AS total, min(amount) AS least FROM transactions
      WHERE origin_country IN ({', '.join(repr(c) for c in K.SANCTIONED_COUNTRIES)}) GROUP BY origin_country)
SELECT origin_country, n, {_compact('total')} AS total, {_compact('least')} AS least FROM s"""
