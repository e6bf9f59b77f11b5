"""Golden rows for the scorecard (rules, bands, blend, attribution)."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators.scoring import score_transactions

PAYLOAD = ("transaction_id string, amount double, origin_country string, destination_country string, "
           "account_age_days bigint, is_international boolean, custom_metrics map<string,double>")


def score(spark, rows, **kw):
    df = spark.createDataFrame(rows, PAYLOAD)
    return {r["transaction_id_n"]: r for r in score_transactions(df, **kw).collect()}


def test_golden_request_hits_three_rules(spark):
    out = score(spark, [("T1", 165000.0, "US", "KP", 1, True, None)])["T1"]
    assert [h["rule_id"] for h in out["rule_hits"]] == [
        "RULE-G01-SANCTION", "RULE-V02-OUTRAGEOUS-AMOUNT", "RULE-A03-NEW-ACCOUNT-VELOCITY"]
    assert (out["final_risk_score"], out["risk_tier"], out["action_decision"]) == (99, "Critical", "Block")
    assert out["rule_hits"][0]["rule_name"] == "OFAC Sanction Match: KP"
    assert "$165,000.00" in out["rule_hits"][1]["reason"]
    assert out["rule_hits"][2]["reason"].startswith("Operational age 1 days")


def test_untrained_state_defaults(spark):
    out = score(spark, [("T0", 10.0, None, None, None, None, None)])["T0"]
    assert out["probability"] == pytest.approx(0.5)
    assert out["ml_score"] == 50
    assert out["final_risk_score"] == 40
    assert (out["risk_tier"], out["action_decision"]) == ("Medium", "Review")
    assert all(a["value"] == 0.0 for a in out["attributions"])
    assert out["key_drivers"] == []


def test_rule_edges(spark):
    rows = [("A", 150000.0, "US", "US", 365, False, None), ("B", 150000.01, "US", "US", 365, False, None),
            ("C", 30000.0, "US", "US", 7, False, None), ("D", 30000.0, "US", "US", 6, False, None)]
    out = score(spark, rows)
    ids = {k: [h["rule_id"] for h in v["rule_hits"]] for k, v in out.items()}
    assert ids["A"] == [] and ids["B"] == ["RULE-V02-OUTRAGEOUS-AMOUNT"]
    assert ids["C"] == [] and ids["D"] == ["RULE-A03-NEW-ACCOUNT-VELOCITY"]
    assert out["D"]["risk_tier"] == "High" and out["D"]["action_decision"] == "Escalate"


@pytest.mark.parametrize("p,tier", [(0.25, "Low"), (0.26, "Medium"), (0.75, "High"), (0.76, "Critical")])
def test_band_edges_without_blend(spark, p, tier):
    import math

    x = math.log(p / (1 - p))  # sigmoid^-1 so the proxy model returns p
    out = score(spark, [("P", 1.0, "US", "US", 365, False, {"F115": x})], bounds=None)["P"]
    assert out["risk_tier"] == tier


def test_attributions_sum_to_shift(spark):
    out = score(spark, [("S", 1.0, "US", "US", 365, False, {"F115": 1.3})])["S"]
    total = sum(a["value"] for a in out["attributions"])
    assert total == pytest.approx(out["probability"] - 0.5, abs=1e-12)
    assert [d["feature"] for d in out["key_drivers"]] == ["F115"]
    assert out["key_drivers"][0]["direction"] == "increases_risk"


def test_disabled_rules(spark):
    df = spark.createDataFrame([("T1", 165000.0, "US", "KP", 1, True, None)], PAYLOAD)
    out = score_transactions(df, rules_enabled=False).first()
    assert out["triggered_rules_count"] == 0 and out["final_risk_score"] == 40


def test_scorecard_struct(spark):
    from riskloom.operators.scoring import scorecard_struct

    df = spark.createDataFrame([("T1", 165000.0, "US", "KP", 1, True, None)], PAYLOAD)
    s = score_transactions(df)
    rec = s.select(scorecard_struct(s).alias("sc")).first()["sc"]
    assert rec["processing_metadata"]["engine_version"] == "v1.0.0-beta"
    assert rec["scores"]["final_risk_score"] == 99
    assert rec["rules_audit"]["triggered_rules_count"] == 3
    assert [o["rule_id"] for o in rec["rules_audit"]["overrides"]][0] == "RULE-G01-SANCTION"
