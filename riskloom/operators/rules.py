"""Policy rules (R1–R5, W4) as a table of Column predicates.

A rule is data: id, trigger score, tier, severity, a predicate over the
payload columns and builders for its name and reason text.  Evaluating the
rule set is one projection: ``array_compact(array(when(pred, hit) ...))``
keeps the hits in rule order, and the elevating rule is the first hit with the
highest trigger score (``array_max`` over ``(score, -position)``).
Users add rules by appending to the list; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalar import money

HIT_FIELDS = ["trigger_score", "neg_position", "rule_id", "rule_name", "tier_enforcement",
              "alert_severity_enforcement", "reason"]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    trigger_score: int
    tier: str
    severity: str
    predicate: Callable[[], Column]
    name: Callable[[], Column]
    reason: Callable[[], Column]


def _sanctioned(c: str) -> Column:
    return F.col(c).isin(*K.SANCTIONED_COUNTRIES)


def sanction_rule() -> Rule:
    score, tier, sev = K.RULE_SCORES[K.RULE_G01_ID]
    return Rule(
        K.RULE_G01_ID, score, tier, sev,
        predicate=lambda: _sanctioned("origin_country_n") | _sanctioned("destination_country_n"),
        # the origin is reported when both match
        name=lambda: F.concat(F.lit(K.RULE_G01_NAME_PREFIX),
                              F.when(_sanctioned("origin_country_n"), F.col("origin_country_n"))
                              .otherwise(F.col("destination_country_n"))),
        reason=lambda: F.lit(K.RULE_G01_REASON),
    )


def volume_rule() -> Rule:
    score, tier, sev = K.RULE_SCORES[K.RULE_V02_ID]
    head, tail = K.RULE_V02_REASON.split("${amount}")
    return Rule(
        K.RULE_V02_ID, score, tier, sev,
        predicate=lambda: F.col("amount_n") > F.lit(K.VOLUME_LIMIT),
        name=lambda: F.lit(K.RULE_V02_NAME),
        reason=lambda: F.concat(F.lit(head), money("amount_n"), F.lit(tail)),
    )


def new_account_rule() -> Rule:
    score, tier, sev = K.RULE_SCORES[K.RULE_A03_ID]
    head, tail = K.RULE_A03_REASON.split("{age}")
    return Rule(
        K.RULE_A03_ID, score, tier, sev,
        predicate=lambda: (F.col("account_age_n") < F.lit(float(K.NEW_ACCOUNT_MAX_AGE)))
        & (F.col("is_international_n") | (F.col("amount_n") > F.lit(K.NEW_ACCOUNT_AMOUNT))),
        name=lambda: F.lit(K.RULE_A03_NAME),
        reason=lambda: F.concat(F.lit(head), F.format_string("%.0f", F.col("account_age_n")), F.lit(tail)),
    )


def anomaly_rule() -> Rule:
    score, tier, sev = K.RULE_SCORES[K.RULE_U04_ID]
    return Rule(
        K.RULE_U04_ID, score, tier, sev,
        predicate=lambda: F.coalesce(F.col("anomaly_label") == F.lit(-1), F.lit(False)),
        name=lambda: F.lit(K.RULE_U04_NAME),
        reason=lambda: F.lit(K.RULE_U04_REASON),
    )


def default_rules(include_anomaly: bool = True) -> list[Rule]:
    rules = [sanction_rule(), volume_rule(), new_account_rule()]
    if include_anomaly:
        rules.append(anomaly_rule())
    return rules


def rule_hits(rules: list[Rule], enabled: bool = True) -> Column:
    """Ordered array<struct> of hits; empty when rules are disabled."""
    if not enabled or not rules:
        return F.array().cast(_hit_type())
    hits = []
    for pos, r in enumerate(rules):
        hit = F.struct(
            F.lit(r.trigger_score).alias("trigger_score"),
            F.lit(-pos).alias("neg_position"),
            F.lit(r.rule_id).alias("rule_id"),
            r.name().alias("rule_name"),
            F.lit(r.tier).alias("tier_enforcement"),
            F.lit(r.severity).alias("alert_severity_enforcement"),
            r.reason().alias("reason"),
        )
        hits.append(F.when(r.predicate(), hit))
    return F.array_compact(F.array(*hits))


def _hit_type() -> str:
    return ("array<struct<trigger_score:int,neg_position:int,rule_id:string,rule_name:string,"
            "tier_enforcement:string,alert_severity_enforcement:string,reason:string>>")


def max_rule(hits: Column) -> Column:
    """First hit with the highest trigger score (NULL when no hit)."""
    return F.array_max(hits)
