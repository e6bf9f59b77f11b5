"""Held-out folds and bounded training samples of labelled documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null ids: fold of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled ids of each class outside the held-out fold.

    Ids are taken by their hash, so the same rows train at any partitioning.  The sampled
    ids are at most 2 * ``per_class``, a bound that makes them safe to broadcast, and an id
    that several documents share gives one row, that of the least text hash; conflicting or
    null labels are left out.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", folds) != held_out))
             .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("__y")).where("y = __y").drop("__y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = reduce(DataFrame.unionByName, [known.where(F.col("y") == c).orderBy(*order).limit(per_class) for c in (0, 1)])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").cast("int").alias("y"))
