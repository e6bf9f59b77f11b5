"""A key with a third of all rows is no one task's work."""

from pyspark.sql import functions as F

from riskloom.operators.skew import SALTS, salted_join


def test_a_hot_key_is_spread(spark):
    n = 60_000
    facts = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("k"))
    one = facts.groupBy("k").agg(F.min("id").alias("first"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        out = salted_join(facts, one, "k", "id", "left")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("first").alias("n")).collect()]
        plain = [r["n"] for r in facts.join(one, "k", "left").groupBy(F.spark_partition_id().alias("p")).agg(F.count("first").alias("n")).collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(sizes) == sum(plain) == n
    assert max(plain) > n / 3 and max(sizes) < n / 3 / SALTS * 3  # two or three salts may meet
    assert sorted(map(tuple, salted_join(facts, one, "k", "id").collect())) == sorted(map(tuple, facts.join(one, "k").collect()))
