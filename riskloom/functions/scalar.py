"""Scalar functions (F1–F25) as Column expressions.

All of these stay inside whole-stage codegen: no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x: Column | str) -> Column:
    """F1."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def clamp(x: Column | str, lo: float, hi: float) -> Column:
    """greatest(lo, least(hi, x))."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(x)))


def round_half_even_int(x: Column | str) -> Column:
    """Python ``int(round(x))`` on doubles — banker's rounding."""
    return F.rint(col(x)).cast("int")


def round_half_up_int(x: Column | str) -> Column:
    """JavaScript ``Math.round`` = floor(x + 0.5)."""
    return F.floor(col(x) + F.lit(0.5)).cast("int")


def upper_strip(x: Column | str) -> Column:
    """F5."""
    return F.upper(F.trim(col(x)))


def capitalise(x: Column | str) -> Column:
    """Python ``str.capitalize`` (first upper, rest lower)."""
    c = col(x)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def truncate_ellipsis(x: Column | str, n: int) -> Column:
    """F8: first n characters plus '...' when longer than n."""
    c = col(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def money(x: Column | str) -> Column:
    """'${:,.2f}'."""
    return F.concat(F.lit("$"), F.format_number(col(x), 2))


def compact_currency(x: Column | str) -> Column:
    """$1.23M / $4.5k / $12 (dashboard money)."""
    c = col(x)
    return (
        F.when(c >= 1000000, F.concat(F.lit("$"), F.format_string("%.2f", c / 1000000), F.lit("M")))
        .when(c >= 1000, F.concat(F.lit("$"), F.format_string("%.1f", c / 1000), F.lit("k")))
        .otherwise(F.concat(F.lit("$"), F.format_number(c, 0)))
    )


def iso_utc(ts: Column | str) -> Column:
    """'%Y-%m-%dT%H:%M:%SZ'."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clock_utc(ts: Column | str) -> Column:
    """F15 time-only form '%H:%M:%S UTC' used in audit logs."""
    return F.concat(F.date_format(col(ts), "HH:mm:ss"), F.lit(" UTC"))


def hashed_alert_id(key: Column | str) -> Column:
    """F16: deterministic 'ALT-XXXX-XXXX' from a key (md5 exists in DuckDB too)."""
    h = F.upper(F.md5(col(key).cast("string")))
    return F.concat(F.lit("ALT-"), F.substring(h, 1, 4), F.lit("-"), F.substring(h, 5, 4))


def hashed_txn_id(key: Column | str) -> Column:
    """F16: deterministic 'TXN-<12 hex>' for payloads without an id."""
    return F.concat(F.lit("TXN-"), F.upper(F.substring(F.md5(col(key).cast("string")), 1, 12)))


def inverted_anomaly_risk(score: Column | str, lo: float, hi: float) -> Column:
    """((max - s)/(max - min))·100 clamped to [0,100]; 50 when flat."""
    denom = hi - lo
    if denom > 0:
        return clamp((F.lit(hi) - col(score)) / F.lit(denom) * F.lit(100.0), 0.0, 100.0)
    return F.lit(50.0)


def round6(x: Column | str) -> Column:
    """Output rounding shared with the SQL oracle."""
    return F.round(col(x), 6)
