"""Alert store operators.

The store is two tables: ``alerts`` (one row per alert, D5 without the log
array) and ``alert_logs`` in long form ``(alert_key, alert_id, log_seq, operator, action,
timestamp)``.  ``id`` is the short form that is shown; it has 32 bits and repeats
in large stores, so every join uses ``alert_key``, which doesn't.  Keeping logs long means no alert's history is ever collected
into one array inside a task; the D5 nested form is built only at the export
edge for bounded selections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.bands import backfill_tier, engine_tier, probability_to_score
from ..functions.scalar import capitalise, clock_utc, hashed_alert_id, iso_utc
from .ranking import global_row_number, last_non_null_before
from .skew import salted_join

ALERT_COLUMNS = ["alert_key", "id", "transaction_id", "sender_id", "receiver_id", "amount", "risk_score", "risk_tier",
                 "severity", "status", "reason", "timestamp", "assigned_to", "seq"]
LOG_COLUMNS = ["alert_key", "alert_id", "log_seq", "operator", "action", "timestamp"]


def reason_summary() -> Column:
    """R13 reason text: tier + rule reasons, or the key-driver names."""
    rule_reasons = F.array_join(F.transform("rule_hits", lambda h: h["reason"]), "; ")
    drivers = F.array_join(F.transform("key_drivers", lambda d: d["feature"]), ", ")
    return F.concat(
        F.col("risk_tier"), F.lit(K.REASON_TRIGGERED),
        F.when(F.size("rule_hits") > 0, F.concat(F.lit(K.REASON_RULES), rule_reasons))
        .otherwise(F.concat(F.lit(K.REASON_DRIVERS), drivers)),
    )


def materialize_alerts(scored: DataFrame, store: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored rows above the threshold become Open alerts (P8 → J2).

    Within the batch the first request per transaction id wins (the reference
    handles requests one by one); against an existing store a transaction id
    that already has an alert is not created again (``left_anti``).  The
    per-id dedupe is a ``groupBy`` with ``min_by`` so a hot id is reduced
    map-side.  Returns ``(alerts, alert_logs)``.
    """
    hit = scored.filter(F.col("final_risk_score") > F.lit(K.ALERT_THRESHOLD))
    rec = F.struct(
        F.col("seq"),
        F.coalesce(F.col("sender_id"), F.lit(K.DEFAULT_SENDER_ID)).alias("sender_id"),
        F.coalesce(F.col("receiver_id"), F.lit(K.DEFAULT_RECEIVER_ID)).alias("receiver_id"),
        F.col("amount_n").alias("amount"),
        F.col("final_risk_score").alias("risk_score"),
        F.col("risk_tier"),
        F.col("alert_severity").alias("severity"),
        reason_summary().alias("reason"),
        iso_utc("ts").alias("timestamp"),
    )
    first = hit.groupBy(F.col("transaction_id_n").alias("transaction_id")).agg(
        F.min_by(rec, F.struct(F.col("seq"))).alias("r"))
    if store is not None:
        first = first.join(store.select("transaction_id"), "transaction_id", "left_anti")
    alerts = first.select(
        F.col("transaction_id").alias("alert_key"),
        hashed_alert_id("transaction_id").alias("id"),
        "transaction_id",
        "r.sender_id", "r.receiver_id", "r.amount", "r.risk_score", "r.risk_tier", "r.severity",
        F.lit("Open").alias("status"),
        "r.reason", "r.timestamp",
        F.lit(K.UNASSIGNED).alias("assigned_to"),
        F.col("r.seq").alias("seq"),
    )
    return alerts, opening_logs(alerts)


def opening_logs(alerts: DataFrame) -> DataFrame:
    """The log row that every alert starts with."""
    return alerts.select(
        "alert_key",
        F.col("id").alias("alert_id"),
        F.lit(0).cast("bigint").alias("log_seq"),
        F.lit(K.SYSTEM_OPERATOR).alias("operator"),
        F.lit(K.AUTO_EVAL_ACTION).alias("action"),
        F.col("timestamp"),
    )


def existing_alert_for(store: DataFrame, scored: DataFrame) -> DataFrame:
    """J2 inner side: requests whose transaction id already has an alert."""
    return scored.join(store.select("transaction_id", F.col("id").alias("associated_alert_id")),
                       scored["transaction_id_n"] == F.col("transaction_id"), "inner")


def filter_alerts(alerts: DataFrame, status: str | None = None, severity: str | None = None) -> DataFrame:
    """Case-insensitive equality filters (pushed into the scan)."""
    out = alerts
    if status:
        out = out.filter(F.lower("status") == F.lit(status.lower()))
    if severity:
        out = out.filter(F.lower("severity") == F.lit(severity.lower()))
    return out


def list_alerts(alerts: DataFrame, status: str | None = None, severity: str | None = None,
                limit: int = K.ALERT_LIST_DEFAULT_LIMIT) -> DataFrame:
    """T1 + W5: total matching count and the newest ``limit`` alerts.

    ``orderBy(..).limit(n)`` plans as a per-partition top-n merged once, so
    only ``n`` rows per partition move; the queue position is numbered on
    those ≤2000 rows.
    """
    if not 1 <= limit <= K.ALERT_LIST_MAX_LIMIT:
        raise ValueError(f"limit must be in 1..{K.ALERT_LIST_MAX_LIMIT}")
    f = filter_alerts(alerts, status, severity)
    count = f.agg(F.count(F.lit(1)).alias("alerts_count"))
    newest = f.orderBy(F.col("seq").desc(), F.col("id")).limit(limit)
    from pyspark.sql import Window

    ranked = newest.withColumn("queue_position", F.row_number().over(Window.orderBy(F.col("seq").desc(), F.col("id"))))
    return ranked.crossJoin(F.broadcast(count))


def page(df: DataFrame, order: list[Column], page_no: int, size: int = K.PAGE_SIZE) -> DataFrame:
    """One page (1-based, page size 5) with 'Showing a to b of n' fields.

    Out-of-range page numbers are clamped to the last page.
    """
    n = df.count()
    pages = max(1, -(-n // size))
    page_no = min(max(1, page_no), pages)
    start = (page_no - 1) * size
    rows = df.orderBy(*order).offset(start).limit(size) if start else df.orderBy(*order).limit(size)
    return rows.select("*", F.lit(start + 1 if n else 0).alias("showing_from"),
                       F.lit(min(start + size, n)).alias("showing_to"), F.lit(n).alias("showing_of"),
                       F.lit(pages).alias("n_pages"))


def critical_recent(alerts: DataFrame, k: int = 3) -> DataFrame:
    """First three alerts above 80 in store (newest-first) order."""
    return alerts.filter(F.col("risk_score") > 80).orderBy(F.col("seq").desc(), F.col("id")).limit(k)


# ------------------------------------------------------------------ workflow


def route_updates(updates: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Send each account-keyed update to the account's newest alert.

    Returns ``(routed, rejected)``; rejected rows are the 404s (no alert).
    ``max_by`` per account is a partial aggregate, so a hot account is
    reduced map-side before the shuffle; the join back is salted.
    """
    newest = alerts.groupBy(F.col("sender_id").alias("account_id")).agg(
        F.max_by(F.struct("alert_key", F.col("id").alias("alert_id")), F.struct("seq", "alert_key")).alias("a")) \
        .select("account_id", "a.alert_key", "a.alert_id")
    routed = salted_join(updates, newest, "account_id", "update_seq")
    rejected = salted_join(updates, newest, "account_id", "update_seq", "left_anti")
    return routed, rejected


def validate_status(updates: DataFrame, status_col: str = "new_status") -> tuple[DataFrame, DataFrame]:
    """P25: capitalised status must be one of the four states; NULL keeps the current one."""
    cap = capitalise(F.col(status_col))
    ok = F.col(status_col).isNull() | cap.isin(*K.ALERT_STATUSES)
    good = updates.filter(ok).withColumn(status_col, F.when(F.col(status_col).isNotNull(), cap))
    bad = updates.filter(~ok)
    return good, bad


def apply_updates(alerts: DataFrame, updates: DataFrame, bucket_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """R16 batch fold of ordered updates ``(alert_key, alert_id, ts, update_seq, new_status, notes, assigned_to)``.

    Updates apply, and their log rows are numbered, in the order of ``(ts, update_seq)``.
    An ``n_updates`` column of ``alerts`` counts what was applied before.

    Each update logs "Changed status from old to new" (even when unchanged),
    then an analyst note if any, then a re-assignment if an assignee is given.
    The state before each update (status, assignee) is a skew-safe
    ``last non-null before`` scan (W10) bucketed by time; final states are
    ``max_by`` aggregates.  Returns ``(alerts_after, update_logs)``.
    """
    earlier = F.col("n_updates") if "n_updates" in alerts.columns else F.lit(0)
    init = alerts.select("alert_key", earlier.cast("bigint").alias("earlier"), F.col("status").alias("init_status"),
                         F.coalesce(F.col("assigned_to"), F.lit(K.UNASSIGNED)).alias("init_assignee"))
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))
    scanned = last_non_null_before(updates, "alert_key", ["ts", "update_seq"], ["new_status", "assigned_to"], bucket, count="n_before")
    s = scanned.join(init, "alert_key")
    old_status = F.coalesce(F.col("new_status_before"), F.col("init_status"))
    new_status = F.coalesce(F.col("new_status"), old_status)
    old_assignee = F.coalesce(F.col("assigned_to_before"), F.col("init_assignee"))
    when = clock_utc("ts")
    entries = F.array(
        F.struct(F.lit(0).alias("k"), F.lit(K.ADMIN_OPERATOR).alias("operator"),
                 F.concat(F.lit("Changed status from "), old_status, F.lit(" to "), new_status).alias("action")),
        F.when(F.coalesce(F.length("notes"), F.lit(0)) > 0,
               F.struct(F.lit(1).alias("k"), F.lit(K.ADMIN_OPERATOR).alias("operator"),
                        F.concat(F.lit("Appended Analyst Note: "), F.col("notes")).alias("action"))),
        F.when(F.col("assigned_to").isNotNull(),
               F.struct(F.lit(2).alias("k"), F.lit(K.ADMIN_OPERATOR).alias("operator"),
                        F.concat(F.lit("Reassigned case from "), old_assignee, F.lit(" to "), F.col("assigned_to"))
                        .alias("action"))),
    )
    logs = s.select(
        "alert_key", "alert_id", (F.col("earlier") + F.col("n_before")).alias("n_before"), when.alias("timestamp"),
        F.explode_outer(F.array_compact(entries)).alias("e"),  # never empty: status entry always present
    ).select(
        "alert_key", "alert_id",
        (F.col("n_before") * F.lit(4) + F.col("e.k") + F.lit(1)).cast("bigint").alias("log_seq"),
        F.col("e.operator").alias("operator"), F.col("e.action").alias("action"), "timestamp",
    )
    order = F.struct(F.col("ts"), F.col("update_seq"))
    final = updates.groupBy("alert_key").agg(
        F.max_by("new_status", F.when(F.col("new_status").isNotNull(), order)).alias("last_status"),
        F.max_by("assigned_to", F.when(F.col("assigned_to").isNotNull(), order)).alias("last_assignee"),
        F.count(F.lit(1)).alias("n_new"),
    )
    after = alerts.join(final, "alert_key", "left").select(
        *[F.col(c) for c in alerts.columns if c not in ("status", "assigned_to", "n_updates")],
        F.coalesce(F.col("last_status"), F.col("status")).alias("status"),
        F.coalesce(F.col("last_assignee"), F.col("assigned_to")).alias("assigned_to"),
        (earlier + F.coalesce(F.col("n_new"), F.lit(0))).cast("bigint").alias("n_updates"),
    )
    return after, logs


# ------------------------------------------------------------ ingest/backfill


def ingest_alerts(requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R14 manual ingest: tier/severity from score/100 unless given, status
    validated (P25), default log row; no dedupe on transaction id.

    ``requests``: transaction_id, sender_id, receiver_id, amount, risk_score,
    risk_tier, severity, status, reason, timestamp, assigned_to, seq.
    Returns ``(alerts, logs, rejected)``.
    """
    cap = capitalise(F.coalesce(F.col("status"), F.lit("Open")))
    ok = cap.isin(*K.ALERT_STATUSES)
    band = probability_to_score(F.col("risk_score") / F.lit(100.0))
    valid = requests.filter(ok)
    key = F.concat(F.lit("ingest|"), F.col("seq").cast("string"))
    alerts = valid.select(
        key.alias("alert_key"),
        hashed_alert_id(key).alias("id"),
        "transaction_id",
        F.coalesce("sender_id", F.lit(K.MANUAL_DEFAULT_ACCOUNT)).alias("sender_id"),
        F.coalesce("receiver_id", F.lit(K.MANUAL_DEFAULT_ACCOUNT)).alias("receiver_id"),
        F.col("amount").cast("double").alias("amount"),
        F.col("risk_score").cast("int").alias("risk_score"),
        F.coalesce("risk_tier", engine_tier(band)).alias("risk_tier"),
        F.coalesce("severity", engine_tier(band)).alias("severity"),
        cap.alias("status"),
        F.coalesce("reason", F.lit(K.MANUAL_DEFAULT_REASON)).alias("reason"),
        F.col("timestamp"),
        F.coalesce("assigned_to", F.lit(K.UNASSIGNED)).alias("assigned_to"),
        "seq",
    )
    logs = alerts.select("alert_key", F.col("id").alias("alert_id"), F.lit(0).cast("bigint").alias("log_seq"),
                         F.lit(K.MANUAL_SYNC_OPERATOR).alias("operator"), F.lit(K.MANUAL_SYNC_ACTION).alias("action"),
                         F.lit("Now").alias("timestamp"))
    rejected = requests.filter(~ok)
    return alerts, logs, rejected


def batch_risk_scores(scored: DataFrame) -> DataFrame:
    """A8 scored-batch rows: Fraud_Probability, ML_Risk, Anomaly_Risk, Final_Risk_Score.

    Anomaly risk is rescaled by the batch's own min/max (one global
    aggregate, broadcast back as a single row, J4).
    """
    s = scored.select("transaction_id_n", "seq", "ts", "probability",
                      F.coalesce(F.col("anomaly_score"), F.lit(0.0)).alias("a") if "anomaly_score" in scored.columns
                      else F.lit(0.0).alias("a"))
    b = s.agg(F.min("a").alias("amin"), F.max("a").alias("amax"))
    j = s.crossJoin(F.broadcast(b))
    anomaly = F.when(F.col("amax") - F.col("amin") > 0,
                     (F.col("amax") - F.col("a")) / (F.col("amax") - F.col("amin")) * F.lit(100.0))
    return j.select(
        "transaction_id_n", "seq", "ts",
        F.col("probability").alias("Fraud_Probability"),
        (F.col("probability") * F.lit(100.0)).alias("ML_Risk"),
        anomaly.alias("Anomaly_Risk"),
    ).withColumn("Final_Risk_Score", F.lit(K.ML_WEIGHT) * F.col("ML_Risk")
                 + F.lit(K.ANOMALY_WEIGHT) * F.coalesce(F.col("Anomaly_Risk"), F.lit(0.0)))


def _template(t: str, row: Column, ml: Column) -> Column:
    head, rest = t.split("{row}")
    mid, tail = rest.split("{ml}")
    return F.concat(F.lit(head), row.cast("string"), F.lit(mid), F.format_string("%.4f", ml), F.lit(tail))


def hash_fraction(key: Column) -> Column:
    """A number in [0, 1) from the md5 of ``key``: the same for a row at any partitioning."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def sample_rows(batch: DataFrame, fraction: float, key: str = "transaction_id_n") -> DataFrame:
    """A deterministic sample of the caller's ``fraction``, by the hash of the key."""
    return batch.filter(hash_fraction(F.col(key)) < F.lit(float(fraction)))


def backfill_alerts(batch: DataFrame, store: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Alerts from every row of a scored batch (bands → templates → parity status).

    Ids ``ALT-DS-%03d`` follow the batch's row order, numbered with the
    distributed ``global_row_number``; odd rows are Closed with two closing
    log entries.  P14: earlier backfill rows in ``store`` are dropped first.
    """
    numbered = global_row_number(batch, [F.col("seq"), F.col("transaction_id_n")], "n")
    score = F.greatest(F.rint(F.col("Final_Risk_Score")).cast("int"), F.lit(2))
    tier = backfill_tier(score)
    ml = F.col("ML_Risk")
    row = F.col("seq")
    reason = (F.when(score >= 50, _template(K.BACKFILL_REASONS["high"], row, ml))
              .when(score >= 25, _template(K.BACKFILL_REASONS["medium"], row, ml))
              .otherwise(_template(K.BACKFILL_REASONS["low"], row, ml)))
    closed = (F.col("n") - F.lit(1)) % F.lit(2) == F.lit(1)
    alerts = numbered.select(
        F.format_string("ALT-DS-%03d", F.col("n")).alias("alert_key"),
        F.format_string("ALT-DS-%03d", F.col("n")).alias("id"),
        F.concat(F.lit("TXN_DS_"), (F.col("seq") + F.lit(1000)).cast("string")).alias("transaction_id"),
        F.format_string("ACC-DS-%03d", F.col("n")).alias("sender_id"),
        F.format_string("ACC-REC-%03d", F.col("n")).alias("receiver_id"),
        (F.lit(150) + (F.col("seq") * F.lit(7919)) % F.lit(1650)).cast("double").alias("amount"),
        score.alias("risk_score"), tier.alias("risk_tier"), tier.alias("severity"),
        F.when(closed, F.lit("Closed")).otherwise(F.lit("Open")).alias("status"),
        reason.alias("reason"),
        F.lit(K.BACKFILL_TIMESTAMP).alias("timestamp"),
        F.when(closed, F.lit(K.ADMIN_OPERATOR)).otherwise(F.lit(K.UNASSIGNED)).alias("assigned_to"),
        F.col("seq"),
    )
    logs = alerts.select(
        "alert_key", F.col("id").alias("alert_id"),
        F.explode_outer(F.array_compact(F.array(
            F.struct(F.lit(0).cast("bigint").alias("log_seq"), F.lit(K.SYSTEM_OPERATOR).alias("operator"),
                     F.lit(K.AUTO_EVAL_ACTION).alias("action"), F.lit(K.BACKFILL_OPEN_TIME).alias("timestamp")),
            F.when(F.col("status") == "Closed", F.struct(
                F.lit(1).cast("bigint").alias("log_seq"), F.lit(K.ADMIN_OPERATOR).alias("operator"),
                F.lit(K.BACKFILL_CLOSE_ACTION).alias("action"), F.lit(K.BACKFILL_CLOSE_TIME).alias("timestamp"))),
            F.when(F.col("status") == "Closed", F.struct(
                F.lit(2).cast("bigint").alias("log_seq"), F.lit(K.ADMIN_OPERATOR).alias("operator"),
                F.lit(K.BACKFILL_CLOSE_NOTE).alias("action"),
                F.lit(K.BACKFILL_CLOSE_TIME).alias("timestamp"))),
        ))).alias("l"),
    ).select("alert_key", "alert_id", "l.*")
    if store is not None:
        kept = store.filter(~(F.col("id").startswith("ALT-LOW-") | F.col("id").startswith("ALT-DS-")))
        alerts = kept.unionByName(alerts, allowMissingColumns=True)  # U1
    return alerts, logs

