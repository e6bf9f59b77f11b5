"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    This cuts the lineage: what follows can use the rows many times, and a lost
    executor costs a reread of files, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> list[Column]:
    """Two independent 64-bit hashes that together identify a text (null as empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), t).alias("h2")]


def same(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    """Null-safe equality over ``cols``: null ids match null ids."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond
