"""SQL (DuckDB dialect) for the derived fixtures and the scorecard.

These strings are the independent oracle side of the correctness gate: the
same definitions as ``sources.fixtures`` / ``operators.scoring`` written as
plain SQL over the raw tables.  Values come from ``constants`` so both sides
share one table of fixed values.
"""

from __future__ import annotations

from .. import constants as K
from ..operators.column_models import ProxyModel


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def transactions_cte() -> str:
    countries = _list(K.FIXTURE_COUNTRIES)
    return f"""
li AS (
  SELECT l_orderkey, count(*) AS n_lines, min(l_suppkey) AS min_suppkey,
         avg(l_discount) AS avg_discount, avg(l_tax) AS avg_tax, sum(l_quantity) AS sum_quantity,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned
  FROM lineitem GROUP BY l_orderkey
),
first_order AS (
  SELECT o_custkey AS fo_custkey, min(o_orderdate) AS first_order_ts FROM orders GROUP BY o_custkey
),
transactions AS (
  SELECT o.o_orderkey AS seq,
         'TXN-' || CAST(o.o_orderkey AS VARCHAR) AS transaction_id,
         'ACC-' || CAST(o.o_custkey AS VARCHAR) AS sender_id,
         CASE WHEN li.n_lines IS NOT NULL THEN 'SUP-' || CAST(li.min_suppkey AS VARCHAR) END AS receiver_id,
         o.o_totalprice * CAST(0.4 AS DOUBLE) AS amount,
         ({countries})[c.c_nationkey + 1] AS origin_country,
         ({countries})[s.s_nationkey + 1] AS destination_country,
         CAST(date_diff('day', CAST(fo.first_order_ts AS DATE), CAST(o.o_orderdate AS DATE)) AS BIGINT) AS account_age_days,
         coalesce(({countries})[c.c_nationkey + 1], '{K.DEFAULT_COUNTRY}')
           <> coalesce(({countries})[s.s_nationkey + 1], '{K.DEFAULT_COUNTRY}') AS is_international,
         o.o_orderdate AS ts,
         CASE WHEN li.n_lines IS NOT NULL THEN (li.n_lines - 4) / CAST(2.0 AS DOUBLE) END AS m_F115,
         li.avg_discount * CAST(10.0 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS m_F321,
         li.avg_tax * CAST(10.0 AS DOUBLE) - CAST(0.4 AS DOUBLE) AS m_F527,
         li.sum_quantity / CAST(100.0 AS DOUBLE) - CAST(1.0 AS DOUBLE) AS m_F670,
         CASE WHEN li.n_lines IS NOT NULL THEN CAST(3 * li.n_returned >= 2 * li.n_lines AS INTEGER) ELSE 0 END AS {K.TARGET_COLUMN}
  FROM orders o
  LEFT JOIN first_order fo ON fo.fo_custkey = o.o_custkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey
  LEFT JOIN supplier s ON s.s_suppkey = li.min_suppkey
)"""


def scored_cte() -> str:
    """Proxy-model scorecard with the untrained-state background (F115 mean 0)."""
    means, ev = ProxyModel().parity_background()
    sanc = _in(K.SANCTIONED_COUNTRIES)
    s = {k: v[0] for k, v in K.RULE_SCORES.items()}
    return f"""
payload AS (
  SELECT t.*,
         upper(trim(coalesce(origin_country, '{K.DEFAULT_COUNTRY}'))) AS oc,
         upper(trim(coalesce(destination_country, '{K.DEFAULT_COUNTRY}'))) AS dc,
         coalesce(amount, CAST(0.0 AS DOUBLE)) AS amt,
         coalesce(CAST(account_age_days AS DOUBLE), CAST({float(K.DEFAULT_ACCOUNT_AGE_DAYS)} AS DOUBLE)) AS age,
         coalesce(m_F115, CAST({means['F115']!r} AS DOUBLE)) AS x115
  FROM transactions t
),
prob AS (
  SELECT *, CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-x115)) AS p
  FROM payload
),
blend AS (
  SELECT *,
         CAST(round_even(greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), p)) * CAST(100.0 AS DOUBLE), 0) AS BIGINT) AS ml_score,
         greatest(CAST(0.0 AS DOUBLE), least(CAST(100.0 AS DOUBLE),
                  CAST({K.ML_WEIGHT} AS DOUBLE) * (p * CAST(100.0 AS DOUBLE)) + CAST({K.ANOMALY_WEIGHT} AS DOUBLE) * CAST(0.0 AS DOUBLE))) AS blended_risk,
         oc IN {sanc} OR dc IN {sanc} AS hit_g01,
         amt > CAST({K.VOLUME_LIMIT} AS DOUBLE) AS hit_v02,
         age < CAST({float(K.NEW_ACCOUNT_MAX_AGE)} AS DOUBLE) AND (is_international OR amt > CAST({K.NEW_ACCOUNT_AMOUNT} AS DOUBLE)) AS hit_a03
  FROM prob
),
banded AS (
  SELECT *,
         CAST(round_even(blended_risk, 0) AS BIGINT) AS blended_score,
         CAST(round_even(greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), blended_risk / CAST(100.0 AS DOUBLE))) * CAST(100.0 AS DOUBLE), 0) AS BIGINT) AS band_score,
         greatest(CASE WHEN hit_g01 THEN {s[K.RULE_G01_ID]} END, CASE WHEN hit_v02 THEN {s[K.RULE_V02_ID]} END,
                  CASE WHEN hit_a03 THEN {s[K.RULE_A03_ID]} END) AS top_rule_score,
         CAST(hit_g01 AS BIGINT) + CAST(hit_v02 AS BIGINT) + CAST(hit_a03 AS BIGINT) AS triggered_rules_count,
         concat_ws(',', CASE WHEN hit_g01 THEN '{K.RULE_G01_ID}' END, CASE WHEN hit_v02 THEN '{K.RULE_V02_ID}' END,
                   CASE WHEN hit_a03 THEN '{K.RULE_A03_ID}' END) AS rule_ids,
         p - CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-CAST({means['F115']!r} AS DOUBLE))) AS marg115,
         p - CAST({ev!r} AS DOUBLE) AS shift
  FROM blend
),
final AS (
  SELECT *,
         {_tier_sql('band_score')} AS blended_tier,
         {_decision_sql('band_score')} AS blended_decision,
         top_rule_score IS NOT NULL AND top_rule_score > blended_score AS elevated,
         CASE WHEN abs(shift) < {K.ATTR_ZERO_SHIFT!r} THEN CAST(0.0 AS DOUBLE)
              WHEN abs(marg115) > {K.ATTR_SCALE_MIN!r} THEN marg115 * (shift / marg115)
              ELSE shift * CAST({1.0 / len(K.HIGHLIGHTED_FEATURES)!r} AS DOUBLE) END AS attr115
  FROM banded
),
scored AS (
  SELECT *,
         CASE WHEN elevated THEN top_rule_score ELSE blended_score END AS final_risk_score,
         CASE WHEN elevated THEN {_rule_tier_sql('top_rule_score')} ELSE blended_tier END AS risk_tier,
         CASE WHEN elevated THEN {_rule_tier_sql('top_rule_score')} ELSE blended_tier END AS alert_severity,
         CASE WHEN elevated THEN {_decision_sql('top_rule_score')} ELSE blended_decision END AS action_decision,
         CASE WHEN abs(attr115) >= {K.DRIVER_MIN_ABS!r} THEN 'F115' END AS driver_features
  FROM final
)"""


def _tier_sql(c: str) -> str:
    return (f"CASE WHEN {c} >= 0 AND {c} <= 25 THEN 'Low' WHEN {c} >= 26 AND {c} <= 50 THEN 'Medium' "
            f"WHEN {c} >= 51 AND {c} <= 75 THEN 'High' ELSE 'Critical' END")


def _decision_sql(c: str) -> str:
    return (f"CASE WHEN {c} >= 0 AND {c} <= 25 THEN 'Approve' WHEN {c} >= 26 AND {c} <= 50 THEN 'Review' "
            f"WHEN {c} >= 51 AND {c} <= 75 THEN 'Escalate' ELSE 'Block' END")


def _rule_tier_sql(c: str) -> str:
    parts = " ".join(f"WHEN {c} = {v[0]} THEN '{v[1]}'" for v in K.RULE_SCORES.values())
    return f"CASE {parts} END"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def alerts_cte() -> str:
    """R13 alerts from the scored CTE (needs ``scored``)."""
    g01, v02, a03 = K.RULE_G01_REASON, K.RULE_V02_REASON, K.RULE_A03_REASON
    v_head, v_tail = v02.split("${amount}")
    a_head, a_tail = a03.split("{age}")
    return f"""
alerts AS (
  SELECT 'ALT-' || upper(substr(md5(transaction_id), 1, 4)) || '-' || upper(substr(md5(transaction_id), 5, 4)) AS id,
         transaction_id,
         coalesce(sender_id, '{K.DEFAULT_SENDER_ID}') AS sender_id,
         coalesce(receiver_id, '{K.DEFAULT_RECEIVER_ID}') AS receiver_id,
         amt AS amount, final_risk_score AS risk_score, risk_tier, alert_severity AS severity,
         'Open' AS status,
         risk_tier || '{K.REASON_TRIGGERED}' || CASE WHEN triggered_rules_count > 0
           THEN '{K.REASON_RULES}' || concat_ws('; ',
                CASE WHEN hit_g01 THEN '{g01}' END,
                CASE WHEN hit_v02 THEN '{v_head}$' || format('{{:,.2f}}', amt) || '{v_tail}' END,
                CASE WHEN hit_a03 THEN '{a_head}' || printf('%.0f', age) || '{a_tail}' END)
           ELSE '{K.REASON_DRIVERS}' || coalesce(driver_features, '') END AS reason,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
         '{K.UNASSIGNED}' AS assigned_to, seq
  FROM scored WHERE final_risk_score > {K.ALERT_THRESHOLD}
)"""


STATES_SQL = "(" + ", ".join(f"'{s}'" for s in K.ALERT_STATUSES) + ")"


def workflow_cte() -> str:
    """C4 updates, J1 routing and the R16 fold (needs ``alerts``)."""
    return f"""
updates AS (
  SELECT 'ACC-' || CAST(user_id * 13 + 1 AS VARCHAR) AS account_id, event_id AS update_seq, ts, event_type,
         CASE WHEN event_id % 97 = 5 THEN 'archived' ELSE CASE event_type WHEN 'view' THEN 'Investigating' WHEN 'error' THEN 'Escalated' WHEN 'purchase' THEN 'Closed' END END AS new_status,
         CASE WHEN event_type IN ('click', 'error') THEN 'Event ' || event_type || ' value ' || format('{{:,.2f}}', value) END AS notes,
         CASE WHEN event_type = 'signup' THEN 'Analyst ' || CAST(user_id % 7 AS VARCHAR) END AS assigned_to
  FROM events
),
newest AS (SELECT sender_id AS account_id, arg_max(transaction_id, (seq, transaction_id)) AS alert_key,
                  arg_max(id, (seq, transaction_id)) AS alert_id FROM alerts GROUP BY sender_id),
all_routed AS (
  SELECT u.* EXCLUDE (new_status), n.alert_key, n.alert_id,
         upper(substr(u.new_status, 1, 1)) || lower(substr(u.new_status, 2)) AS new_status
  FROM updates u JOIN newest n ON n.account_id = u.account_id),
routed AS (SELECT * FROM all_routed WHERE new_status IS NULL OR new_status IN {STATES_SQL}),
invalid AS (SELECT * FROM all_routed WHERE new_status NOT IN {STATES_SQL}),
rejected AS (SELECT u.* FROM updates u WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.account_id = u.account_id)),
folded AS (
  SELECT r.*, a.status AS init_status, coalesce(a.assigned_to, '{K.UNASSIGNED}') AS init_assignee,
         last_value(r.new_status IGNORE NULLS) OVER w AS status_before,
         last_value(r.assigned_to IGNORE NULLS) OVER w AS assignee_before
  FROM routed r JOIN alerts a ON a.transaction_id = r.alert_key
  WINDOW w AS (PARTITION BY r.alert_key ORDER BY r.ts, r.update_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
steps AS (
  SELECT *, coalesce(status_before, init_status) AS old_status,
         coalesce(new_status, status_before, init_status) AS status_after,
         coalesce(assignee_before, init_assignee) AS old_assignee,
         row_number() OVER (PARTITION BY alert_key ORDER BY ts, update_seq) - 1 AS n_before,
         strftime(ts, '%H:%M:%S') || ' UTC' AS log_time
  FROM folded
),
update_logs AS (
  SELECT alert_key, alert_id, n_before * 4 + 1 AS log_seq, '{K.ADMIN_OPERATOR}' AS operator,
         'Changed status from ' || old_status || ' to ' || status_after AS action, log_time AS timestamp FROM steps
  UNION ALL
  SELECT alert_key, alert_id, n_before * 4 + 2, '{K.ADMIN_OPERATOR}', 'Appended Analyst Note: ' || notes, log_time
  FROM steps WHERE length(coalesce(notes, '')) > 0
  UNION ALL
  SELECT alert_key, alert_id, n_before * 4 + 3, '{K.ADMIN_OPERATOR}', 'Reassigned case from ' || old_assignee || ' to ' || assigned_to, log_time
  FROM steps WHERE assigned_to IS NOT NULL
),
last_step AS (
  SELECT alert_key, status_after, n_updates,
         coalesce(assigned_to, assignee_before, init_assignee) AS assignee_after
  FROM (SELECT *, row_number() OVER (PARTITION BY alert_key ORDER BY ts DESC, update_seq DESC) AS rn,
               count(*) OVER (PARTITION BY alert_key) AS n_updates FROM steps) x
  WHERE rn = 1
),
after AS (
  SELECT a.id, a.transaction_id, a.sender_id, a.receiver_id, a.amount, a.risk_score, a.risk_tier, a.severity,
         a.reason, a.timestamp, a.seq,
         coalesce(l.status_after, a.status) AS status,
         coalesce(l.assignee_after, a.assigned_to) AS assigned_to,
         coalesce(l.n_updates, 0) AS n_updates
  FROM alerts a LEFT JOIN last_step l ON l.alert_key = a.transaction_id
)"""


def alert_view_cte(src: str = "after") -> str:
    """P17–P20 analyst view (needs ``src``)."""
    return f"""
view AS (
  SELECT id, seq,
         coalesce(sender_id, '{K.DEFAULT_RECEIVER_ID}') AS account_number,
         CASE WHEN starts_with(id, 'ALT-TGT-') OR coalesce(risk_score, 0) >= 50 THEN 'Mule Account'
              WHEN length(coalesce(reason, '')) > 0 AND contains(reason, 'Dataset Target Fraud Account') THEN 'Mule Account'
              WHEN length(coalesce(reason, '')) > 0 AND contains(reason, 'Low Risk Dataset Account') THEN 'Normal Account Profile'
              WHEN length(coalesce(reason, '')) > 0 AND contains(reason, 'triggered') THEN
                   CASE WHEN length(trim(split_part(reason, 'triggered', 1))) > 0 THEN trim(split_part(reason, 'triggered', 1))
                        ELSE 'Policy Trigger Exception' END
              WHEN length(coalesce(reason, '')) > 0 THEN
                   CASE WHEN length(split_part(reason, '.', 1)) > 35 THEN substr(split_part(reason, '.', 1), 1, 35) || '...'
                        ELSE split_part(reason, '.', 1) END
              ELSE 'Rapid Fund Transfer (Mule)' END AS type,
         reason,
         coalesce(risk_score, 0) AS risk_score,
         CAST(floor(CAST(50.0 AS DOUBLE) + coalesce(risk_score, 0) / CAST(2.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS confidence_val,
         coalesce(status, 'Open') AS status, severity,
         CASE WHEN receiver_id IS NOT NULL THEN 'Beneficiary: ' || receiver_id ELSE 'Robert P. Jenkins' END AS holder_name,
         coalesce(amount, CAST(0.0 AS DOUBLE)) AS balance,
         coalesce(amount, CAST(0.0 AS DOUBLE)) * CAST(1.2 AS DOUBLE) AS ytd_inflows,
         CASE WHEN severity = 'Critical' THEN 'P1 - Immediate' WHEN severity = 'High' THEN 'P2 - Review' ELSE 'P3 - Monitor' END AS prio,
         coalesce(assigned_to, '{K.UNASSIGNED}') AS assigned_to
  FROM {src}
)"""


FAULT_COLUMNS_SQL = {
    "F12_excess_missing": "CASE WHEN vec_id % 10 < 4 THEN F5 END",
    "F34_constant": "CAST(3.924 AS DOUBLE)",
    "F56_leak_target": "CAST(F3924 AS DOUBLE) + CAST(1e-4 AS DOUBLE) * F2",
    "F3924_derived_rule": "CAST(F3924 AS DOUBLE)",
    "F_collinear_a": "CAST(1.5 AS DOUBLE) * F1",
    "F_collinear_b": "CAST(1.5 AS DOUBLE) * F1 + CAST(1e-3 AS DOUBLE) * F2",
    "F_cat_deterministic_leak": "CASE WHEN F3924 = 1 THEN 'FLAG_APPROVED' ELSE 'FLAG_PENDING' END",
    "F_cat_ok": "'C' || CAST(vec_id % 3 AS VARCHAR)",
    "F_highly_predictive": "CAST(2.0 AS DOUBLE) * CAST(F3924 AS DOUBLE) + F3",
    "F_nan_holes": "CASE WHEN vec_id % 7 <> 0 THEN F6 END",
    "F_cat_nan_text": "CASE WHEN vec_id % 5 > 1 THEN 'D' || CAST(vec_id % 2 AS VARCHAR) END",
}
CATEGORICAL_FAULTS = ["F_cat_deterministic_leak", "F_cat_ok", "F_cat_nan_text"]


def features_cte() -> str:
    dims = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS F{i}" for i in range(64))
    faults = ", ".join(f"{e} AS \"{c}\"" for c, e in FAULT_COLUMNS_SQL.items())
    return f"""
fm AS (SELECT vec_id, CAST(label = 0 AS INTEGER) AS {K.TARGET_COLUMN}, {dims} FROM embeddings),
features AS (SELECT *, {faults} FROM fm)"""


def feature_columns() -> list[str]:
    return [f"F{i}" for i in range(64)] + list(FAULT_COLUMNS_SQL)


def numeric_feature_columns() -> list[str]:
    return [c for c in feature_columns() if c not in CATEGORICAL_FAULTS]
