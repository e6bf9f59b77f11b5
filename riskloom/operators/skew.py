"""Joins of a fact side with hot keys to a side of one row per key.

AQE splits a hot partition only where both sides come straight from a shuffle.  Where the
one-row side is an aggregate it doesn't, so such joins are salted: the one-row side is
repeated ``SALTS`` times and a hash of another column spreads a key's facts over the
copies.  The repeats cost ``SALTS`` small rows per key and bound a hot key's share of a
task by its share of the rows over ``SALTS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(facts: DataFrame, one: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``facts`` joined to ``one`` (one row per ``key``) on ``key``; ``spread`` varies within a key."""
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    left = facts.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = one.withColumn("__salt", F.explode(salts))
    return left.join(right, [key, "__salt"], how).drop("__salt")
