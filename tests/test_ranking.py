"""Distributed numbering and the skew-safe 'last non-null before' scan."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators.ranking import global_row_number, last_non_null_before


def test_global_row_number_is_consecutive(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id"))
    out = global_row_number(df, [F.col("k"), F.col("id")], "n", partitions=7)
    rows = out.select("k", "id", "n").collect()
    assert sorted(r["n"] for r in rows) == list(range(1, 5001))
    by_n = sorted(rows, key=lambda r: r["n"])
    assert [(r["k"], r["id"]) for r in by_n] == sorted((r["k"], r["id"]) for r in rows)


def test_last_non_null_before_matches_window_with_hot_key(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}"  # a third of all rows on one key
        val = rnd.choice([None, None, "a", "b", "c"])
        rows.append((key, i, rnd.randint(0, 10_000), val))
    df = spark.createDataFrame(rows, "key string, seq int, t int, v string")
    got = last_non_null_before(df, "key", ["t", "seq"], ["v"], F.floor(F.col("t") / 500))
    w = Window.partitionBy("key").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("seq", F.last("v", ignorenulls=True).over(w).alias("want"))
    joined = got.join(want, "seq").filter(~F.col("v_before").eqNullSafe(F.col("want")))
    assert joined.count() == 0
