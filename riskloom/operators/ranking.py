"""Ordering helpers that never route a whole table through one task.

``global_row_number`` numbers rows 1..n in a total order (F17 sequence ids,
T7 pagination over big results, W5 queue positions).  A window with no
PARTITION BY would pull every row into one task; instead the frame is
range-partitioned on the order key and sorted within partitions, each row
takes its index inside its partition, and a tiny per-partition count table
(one row per partition) gives each partition's offset.

The partitioned, locally numbered frame is checkpointed (reliable, in the
shared checkpoint folder) before it is read twice — once for the counts,
once for the join — so both reads see the same partition boundaries even
when an executor is lost and a stage is recomputed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_no",
                      partitions: int | None = None) -> DataFrame:
    """Append a 1-based consecutive number following ``order``.

    ``order`` must end in a unique tie-breaker so the numbering is
    deterministic (and so a recomputed partition after an executor loss gets
    the same numbers).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("__mid", F.monotonically_increasing_id())
        .withColumn("__pid", F.shiftrightunsigned(F.col("__mid"), 33))
        .withColumn("__local", F.col("__mid") - F.shiftleft(F.col("__pid"), 33))
    )
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid",
        (F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
        .alias("__offset"),
    )
    return (
        ranged.join(F.broadcast(offsets), "__pid")
        .withColumn(name, F.col("__offset") + F.col("__local") + F.lit(1))
        .drop("__mid", "__pid", "__local", "__offset")
    )


def last_non_null_before(
    df: DataFrame,
    key: str,
    order: list[str],
    values: list[str],
    bucket: Column,
    suffix: str = "_before",
    count: str | None = None,
) -> DataFrame:
    """For each row, the last non-null value of each ``values`` column among
    earlier rows of the same ``key`` (W10 ``lag ignore nulls``), skew-safe.

    A plain window partitioned by ``key`` puts a hot key (say a third of all
    rows) in one task.  Here rows are also split by ``bucket`` (a coarse,
    order-aligned column such as the hour of the timestamp):

    1. within ``(key, bucket)`` a window gives the local answer;
    2. a ``groupBy(key, bucket)`` (partial aggregation first) gives each
       bucket's last non-null value;
    3. a window over that small summary (one row per key and bucket) carries
       the value of earlier buckets forward;
    4. the carry is joined back and used where the local answer is null.

    ``count`` names a column for the number of earlier rows of the key.
    """
    ordered = [F.col(c) for c in order]
    w_local = (Window.partitionBy(key, "__bucket").orderBy(*ordered)
               .rowsBetween(Window.unboundedPreceding, -1))
    b = df.withColumn("__bucket", bucket)
    local = b.select("*", F.count(F.lit(1)).over(w_local).alias("__loc_n"),
                     *[F.last(v, ignorenulls=True).over(w_local).alias(f"__loc_{v}") for v in values])
    order_struct = F.struct(*ordered)
    summary = b.groupBy(key, "__bucket").agg(
        F.count(F.lit(1)).alias("__sum_n"),
        *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), order_struct)).alias(f"__sum_{v}") for v in values]
    )
    w_carry = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        key, "__bucket", F.coalesce(F.sum("__sum_n").over(w_carry), F.lit(0)).alias("__car_n"),
        *[F.last(f"__sum_{v}", ignorenulls=True).over(w_carry).alias(f"__car_{v}") for v in values],
    )
    out = local.join(carry, [key, "__bucket"], "left")
    return out.select(
        *[c for c in df.columns],
        *[F.coalesce(F.col(f"__loc_{v}"), F.col(f"__car_{v}")).alias(f"{v}{suffix}") for v in values],
        *([(F.col("__loc_n") + F.col("__car_n")).alias(count)] if count else []),
    )


def prefix_sum(df: DataFrame, order: list[Column], values: list[str], suffix: str = "_before",
               partitions: int | None = None) -> DataFrame:
    """Exclusive running sums of the integer ``values`` along a total ``order``, distributed.

    One shuffle: rows are range-partitioned and sorted on the order key, each partition
    adds up its own rows as they come, and the partitions' totals (one row each) give the
    offsets.  The summed frame is checkpointed so the totals and the rows agree on the
    boundaries.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(spark)
    counted = df.withColumns({v: F.coalesce(F.col(v), F.lit(0)).cast("bigint") for v in values})
    ranged = counted.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id())
    names = [*ranged.columns, *[f"__l_{v}" for v in values]]
    places = [ranged.columns.index(v) for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * len(places)
        for b in batches:
            local = []
            for i, place in enumerate(places):
                x = b.column(place).to_numpy()
                upto = np.cumsum(x)
                local.append(pa.array(upto - x + sums[i], pa.int64()))
                sums[i] += int(upto[-1]) if len(upto) else 0
            yield pa.RecordBatch.from_arrays([*b.columns, *local], names)

    schema = ranged.withColumns({f"__l_{v}": F.lit(0).cast("bigint") for v in values}).schema
    local = ranged.mapInArrow(run, schema).checkpoint(eager=True)
    totals = local.groupBy("__pid").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    w_off = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", *[F.coalesce(F.sum(f"__t_{v}").over(w_off), F.lit(0)).alias(f"__o_{v}") for v in values])
    out = local.join(F.broadcast(offsets), "__pid")
    return out.select(*df.columns, *[(F.col(f"__o_{v}") + F.col(f"__l_{v}")).alias(f"{v}{suffix}") for v in values])
