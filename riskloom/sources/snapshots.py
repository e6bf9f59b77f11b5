"""Versions of the alert store (S7, S8): a fresh folder a write, then one pointer file.

A writer fills a folder that nothing reads yet and then replaces the pointer in one rename,
so a reader sees the old snapshot or the new one, whole; a write that fails leaves the
old one.  A reader resolves the pointer once and keeps that folder.  Older folders stay
until ``forget`` is called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .io import ALERT_SCHEMA, LOG_SCHEMA, read_alert_snapshot, write_alert_snapshot

POINTER = "CURRENT"


def _files(spark: SparkSession, base: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(base)
    return jvm, path.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)


def current(spark: SparkSession, base: str) -> str | None:
    """The folder of the newest snapshot, None before the first."""
    jvm, fs, _ = _files(spark, base)
    pointer = jvm.org.apache.hadoop.fs.Path(base, POINTER)
    if not fs.exists(pointer):
        return None
    return f"{base.rstrip('/')}/{spark.read.text(pointer.toString()).first()[0]}"


def commit(alerts: DataFrame, logs: DataFrame, base: str) -> str:
    """Write a new snapshot and make it the current one; its folder."""
    spark = alerts.sparkSession
    name = f"snapshot-{uuid.uuid4().hex}"
    write_alert_snapshot(alerts, logs, f"{base.rstrip('/')}/{name}")
    jvm, fs, context = _files(spark, base)
    fresh, pointer = (jvm.org.apache.hadoop.fs.Path(base, n) for n in (f"{POINTER}-{name}", POINTER))
    out = fs.create(fresh)
    try:
        out.write(bytearray(name.encode()))
    finally:
        out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(pointer), rename)
    return f"{base.rstrip('/')}/{name}"


def read(spark: SparkSession, base: str, seed: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(alerts, logs) of the current snapshot; ``seed`` where there is none or it holds no alert."""
    folder = current(spark, base)
    if folder is not None:
        alerts, logs = read_alert_snapshot(spark, folder)
        if seed is None or alerts.limit(1).count():
            return alerts, logs
    if seed is not None:
        return seed
    return spark.createDataFrame([], ALERT_SCHEMA), spark.createDataFrame([], LOG_SCHEMA)


def forget(spark: SparkSession, base: str, keep: list[str]) -> None:
    """Remove the snapshots that are neither current nor in ``keep`` (folders that readers still use)."""
    jvm, fs, _ = _files(spark, base)
    kept = {f.rstrip("/").rsplit("/", 1)[-1] for f in [*keep, current(spark, base) or ""]}
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(base)):
        name = status.getPath().getName()
        if name.startswith("snapshot-") and name not in kept:
            fs.delete(status.getPath(), True)
