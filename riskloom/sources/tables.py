"""Table scans and input normalisation.

``load_tables`` registers the test-data tables; every later operator reads
them lazily so Catalyst can prune columns and push filters into the parquet
scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` is a parquet scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def numeric_types() -> tuple:
    # bool and dates count as non-numeric
    return (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def split_columns(df: DataFrame, exclude: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric vs categorical columns by schema (driver-side, schema only)."""
    exclude = set(exclude or [])
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        (num if isinstance(f.dataType, numeric_types()) else cat).append(f.name)
    return num, cat


def missing_to_null(c: Column, dtype: T.DataType) -> Column:
    """NaN (numeric) and the strings 'nan'/'None' (text) become NULL."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), F.lit(None).cast(dtype)).otherwise(c)
    if isinstance(dtype, T.StringType):
        return F.when(c.isin("nan", "None"), F.lit(None).cast("string")).otherwise(c)
    return c


def normalise_missing(df: DataFrame) -> DataFrame:
    """S6 over a whole frame: one narrow projection."""
    return df.select([missing_to_null(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """``to_numeric(errors='coerce')`` → ``try_cast(.. as double)``."""
    wanted = set(columns)
    return df.select([
        (F.col(f"`{c}`").try_cast("double") if c in wanted else F.col(f"`{c}`")).alias(c)
        for c in df.columns
    ])
