"""The alert workflow as a stream of update requests.

The store is the alert table as it was opened and an append-only log of updates.  Each
micro-batch routes and validates its requests and writes them under its own batch id, so
a batch replayed after a failure writes the same rows again instead of applying twice.
The current state is the batch operator (``apply_updates``) over the log: updates apply in
the order of ``(ts, update_seq)`` whatever batch brought them.  ``compact`` folds what is
settled into a new opening table, so the log that is folded stays short.  State lives in
tables in the shared folder, not in executor memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alerts import apply_updates, opening_logs, route_updates, validate_status
from ..session import scratch_path
from ..sources.io import ALERT_SCHEMA, LOG_SCHEMA

STATE_SCHEMA = ALERT_SCHEMA + ", n_updates long"
UPDATE_COLUMNS = ["alert_key", "alert_id", "account_id", "update_seq", "ts", "event_type", "new_status", "notes", "assigned_to"]


def open_store(alerts: DataFrame, base: str, updates: DataFrame) -> None:
    """Write the opening tables; ``updates`` gives the requests' schema."""
    alerts = alerts if "n_updates" in alerts.columns else alerts.withColumn("n_updates", F.lit(0).cast("long"))
    alerts.select(*[c.split()[0] for c in STATE_SCHEMA.split(", ")]).write.parquet(f"{base}/alerts")
    opened = alerts.sparkSession.read.schema(STATE_SCHEMA).parquet(f"{base}/alerts")  # the store is built once
    opening_logs(opened).write.parquet(f"{base}/logs")
    empty = route_updates(updates.limit(0), opened.limit(0))[0]
    empty.select(*UPDATE_COLUMNS).write.parquet(f"{base}/updates/batch_id=-1")


def workflow_sink(base: str):
    def apply(batch: DataFrame, batch_id: int) -> None:
        alerts = batch.sparkSession.read.schema(STATE_SCHEMA).parquet(f"{base}/alerts")
        routed, rejected = route_updates(batch, alerts)
        valid, invalid = validate_status(routed)
        valid.select(*UPDATE_COLUMNS).write.mode("overwrite").parquet(f"{base}/updates/batch_id={batch_id}")
        refused = rejected.withColumn("reason", F.lit("unknown account")).unionByName(
            invalid.select(*rejected.columns).withColumn("reason", F.lit("invalid status")))
        refused.write.mode("overwrite").parquet(f"{base}/rejected/batch_id={batch_id}")

    return apply


def current_state(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(alerts with ``n_updates``, all log rows)."""
    alerts = spark.read.schema(STATE_SCHEMA).parquet(f"{base}/alerts")
    updates = spark.read.parquet(f"{base}/updates").select(*UPDATE_COLUMNS)
    after, logs = apply_updates(alerts, updates)
    return after, spark.read.schema(LOG_SCHEMA).parquet(f"{base}/logs").unionByName(logs)


def compact(spark: SparkSession, base: str, new_base: str) -> None:
    """Open a new store at ``new_base`` from the current state of the one at ``base``."""
    after, logs = current_state(spark, base)
    after.select(*[c.split()[0] for c in STATE_SCHEMA.split(", ")]).write.parquet(f"{new_base}/alerts")
    logs.write.parquet(f"{new_base}/logs")
    spark.read.parquet(f"{base}/updates").select(*UPDATE_COLUMNS).limit(0).write.parquet(f"{new_base}/updates/batch_id=-1")


def run_workflow_stream(spark: SparkSession, updates_path: str, schema, base: str,
                        checkpoint: str | None = None, files_per_batch: int = 4) -> None:
    checkpoint = checkpoint or scratch_path(spark, "workflow-ckpt")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(updates_path)
    q = (stream.writeStream.foreachBatch(workflow_sink(base)).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
