"""The five risk-band systems, kept as separate named functions.

They disagree at their edges on purpose (score 75 is High in the engine but
Critical in the backfill and the dashboard); each caller picks its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp, col


def probability_to_score(p: Column | str) -> Column:
    """Clamp to [0,1], ×100, half-even to an int."""
    return F.rint(clamp(col(p), 0.0, 1.0) * F.lit(100.0)).cast("int")


def engine_tier(score: Column | str) -> Column:
    """Engine bands on an int score: 0–25 Low, 26–50 Medium, 51–75 High, else Critical."""
    s = col(score)
    return (
        F.when((s >= 0) & (s <= 25), F.lit("Low"))
        .when((s >= 26) & (s <= 50), F.lit("Medium"))
        .when((s >= 51) & (s <= 75), F.lit("High"))
        .otherwise(F.lit("Critical"))
    )


def engine_decision(score: Column | str) -> Column:
    s = col(score)
    return (
        F.when((s >= 0) & (s <= 25), F.lit("Approve"))
        .when((s >= 26) & (s <= 50), F.lit("Review"))
        .when((s >= 51) & (s <= 75), F.lit("Escalate"))
        .otherwise(F.lit("Block"))
    )


def backfill_tier(score: Column | str) -> Column:
    """Backfill bands: ≥75 Critical, ≥50 High, ≥25 Medium, else Low."""
    s = col(score)
    return (
        F.when(s >= 75, F.lit("Critical")).when(s >= 50, F.lit("High"))
        .when(s >= 25, F.lit("Medium")).otherwise(F.lit("Low"))
    )


def dashboard_band(score: Column | str) -> Column:
    """Dashboard bands: <50 low, 50–74 medium, ≥75 high."""
    s = col(score)
    return F.when(s < 50, F.lit("low")).when(s < 75, F.lit("medium")).otherwise(F.lit("high"))


def explorer_band(score: Column | str) -> Column:
    """Explorer bands: ≥90, 80–89, 60–79, <60."""
    s = col(score)
    return (
        F.when(s >= 90, F.lit("90+")).when(s >= 80, F.lit("80-89"))
        .when(s >= 60, F.lit("60-79")).otherwise(F.lit("<60"))
    )


def confidence_label(score: Column | str) -> Column:
    """Confidence bands on the risk score: ≥80 High, ≥60 Medium, else Low."""
    s = col(score)
    return F.when(s >= 80, F.lit("High")).when(s >= 60, F.lit("Medium")).otherwise(F.lit("Low"))
