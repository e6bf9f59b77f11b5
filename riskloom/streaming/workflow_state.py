"""X4 with keyed state: one stateful operator per alert in place of a folded log.

State of an alert: its status, assignee and number of applied updates (a value), and the
updates that the watermark has not passed yet (a list).  Updates wait in the list until the watermark
passes them; a timer then applies them in the order of ``(ts, update_seq)``, so the result doesn't
depend on which micro-batch brought what.  A micro-batch touches the alerts it
names and those whose timer is due, nothing that was applied before: its cost does not grow
with the log.  An alert's state opens from the opening alerts when its first request comes, which
brings the opening status and assignee along: alerts without requests cost nothing.

Requests older than the watermark when they come are dropped; ``delay`` is how late they
may be.  What still waits when a stream ends is applied once later requests, or ``close``,
move the watermark on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from .. import constants as K
from ..functions.scalar import clock_utc
from ..operators.alerts import validate_status
from .scorecard_stream import with_event_time
from .workflow_stream import STATE_SCHEMA, UPDATE_COLUMNS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CLOSING = "2200-01-01 00:00:00"
OPENING = ["opening_status", "opening_assignee", "opening_updates"]
WAITING = "alert_id string, update_seq bigint, micros bigint, new_status string, notes string, assigned_to string"
APPLIED = ("alert_key string, alert_id string, n_before bigint, update_seq bigint, micros bigint, old_status string, status string, "
           "notes string, old_assignee string, new_assignee string")


class AlertWorkflow(StatefulProcessor):
    """Applies an alert's updates in their order and gives one row for each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "status string, assignee string, applied bigint")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        due, opened = set(), self.current.exists()
        for pdf in rows:
            if not opened and len(pdf) and not pd.isna(pdf["opening_updates"].iloc[0]):
                first = pdf.iloc[0]
                self.current.update((first["opening_status"], first["opening_assignee"], int(first["opening_updates"])))
                opened = True
            new = [tuple(None if pd.isna(v) else v for v in r) for r in
                   pdf[["alert_id", "update_seq", "micros", "new_status", "notes", "assigned_to"]].itertuples(index=False)]
            if new:
                self.waiting.appendList(new)
                due |= {int(r[2]) // 1000 + 1 for r in new}
        if due:
            # one timer, for the first of them; it sets the next
            pending = min([*due, *self.handle.listTimers()])
            self.handle.registerTimer(pending)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(((u[2], u[1]), tuple(u)) for u in self.waiting.get())
        ready, later = [u for _, u in waiting if u[2] // 1000 < passed], [u for _, u in waiting if u[2] // 1000 >= passed]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][2] // 1000 + 1)
        status, assignee, applied = self.current.get() or (None, None, 0)
        out = []
        for alert_id, seq, micros, new_status, notes, assigned_to in ready:
            now = new_status if new_status is not None else status
            out.append((key[0], alert_id, applied, seq, micros, status, now, notes, assignee, assigned_to))
            status, applied = now, applied + 1
            assignee = assigned_to if assigned_to is not None else assignee
        self.current.update((status, assignee, applied))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in APPLIED.split(", ")])


def open_state(alerts: DataFrame, base: str) -> None:
    """Write the opening alerts and an empty table of applied updates."""
    alerts = alerts if "n_updates" in alerts.columns else alerts.withColumn("n_updates", F.lit(0).cast("long"))
    alerts.select(*[c.split()[0] for c in STATE_SCHEMA.split(", ")]).write.parquet(f"{base}/alerts")
    alerts.sparkSession.createDataFrame([], APPLIED).write.parquet(f"{base}/applied/batch_id=-1")


def applied_updates(updates: DataFrame, delay: str) -> DataFrame:
    """Applied updates from a stream of routed and checked ones, which bring their alert's opening state (``OPENING``)."""
    timed = with_event_time(updates).withColumn("micros", F.unix_micros("event_time"))
    return (timed.select("alert_key", "alert_id", "update_seq", "micros", "event_time", "new_status", "notes", "assigned_to", *OPENING)
            .withWatermark("event_time", delay).groupBy("alert_key")
            .transformWithStateInPandas(AlertWorkflow(), APPLIED, "append", "EventTime"))


def close(spark: SparkSession, updates: DataFrame, path: str) -> None:
    """Add one request of the far future, for no account, to the stream's folder."""
    empty = updates.limit(0)
    last = spark.range(1).select(*[F.lit(CLOSING).cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema])
    last.write.mode("append").parquet(path)


def run_state_stream(spark: SparkSession, updates_path: str, schema, base: str, checkpoint: str, delay: str, files_per_batch: int = 4) -> None:
    """Process what is in ``updates_path`` and not yet in ``checkpoint``, then stop."""
    alerts = spark.read.schema(STATE_SCHEMA).parquet(f"{base}/alerts")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(updates_path)
    newest = alerts.groupBy(F.col("sender_id").alias("account_id")).agg(
        F.max_by(F.struct("alert_key", F.col("id").alias("alert_id"), F.col("status").alias("opening_status"),
                          F.coalesce("assigned_to", F.lit(K.UNASSIGNED)).alias("opening_assignee"), F.col("n_updates").alias("opening_updates")),
                 F.struct("seq", "alert_key")).alias("a")).select("account_id", "a.*")
    # the closing request has no account: it only moves the watermark, as a key of its own
    routed = stream.join(newest, "account_id", "left").where(F.col("alert_key").isNotNull() | F.col("account_id").isNull())
    valid, _ = validate_status(routed.withColumn("alert_key", F.coalesce("alert_key", F.lit(""))))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        def write(batch: DataFrame, batch_id: int) -> None:
            # a replayed batch writes the same folder again
            batch.where("alert_key <> ''").write.mode("overwrite").parquet(f"{base}/applied/batch_id={batch_id}")

        (applied_updates(valid.select(*UPDATE_COLUMNS, *OPENING), delay).writeStream.outputMode("append").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def state_logs(applied: DataFrame) -> DataFrame:
    """The log rows of applied updates, numbered as the batch fold numbers them."""
    entries = F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.lit("Changed status from "), "old_status", F.lit(" to "), "status").alias("action")),
        F.when(F.coalesce(F.length("notes"), F.lit(0)) > 0, F.struct(F.lit(1).alias("k"), F.concat(F.lit("Appended Analyst Note: "), "notes").alias("action"))),
        F.when(F.col("new_assignee").isNotNull(), F.struct(F.lit(2).alias("k"), F.concat(F.lit("Reassigned case from "), "old_assignee", F.lit(" to "), "new_assignee").alias("action"))))
    rows = applied.select("alert_key", "alert_id", "n_before", clock_utc(F.timestamp_micros("micros")).alias("timestamp"), F.explode_outer(F.array_compact(entries)).alias("e"))
    return rows.select("alert_key", "alert_id", (F.col("n_before") * 4 + F.col("e.k") + 1).cast("bigint").alias("log_seq"),
                       F.lit(K.ADMIN_OPERATOR).alias("operator"), F.col("e.action").alias("action"), "timestamp")


def state_of(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(alerts with ``n_updates``, log rows of the applied updates)."""
    alerts = spark.read.schema(STATE_SCHEMA).parquet(f"{base}/alerts")
    applied = spark.read.parquet(f"{base}/applied").drop("batch_id")
    last = applied.groupBy("alert_key").agg(F.max_by("status", "n_before").alias("last_status"), F.max("n_before").alias("n"),
                                            F.max_by("new_assignee", F.when(F.col("new_assignee").isNotNull(), F.col("n_before"))).alias("last_assignee"))
    after = alerts.join(last, "alert_key", "left").select(
        *[c for c in alerts.columns if c not in ("status", "assigned_to", "n_updates")], F.coalesce("last_status", "status").alias("status"),
        F.coalesce("last_assignee", "assigned_to").alias("assigned_to"), F.coalesce(F.col("n") + 1, "n_updates").alias("n_updates"))
    return after, state_logs(applied)
