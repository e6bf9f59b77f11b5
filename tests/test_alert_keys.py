"""Two alerts may share the short id that is shown; they stay apart everywhere else."""

import hashlib

from pyspark.sql import functions as F

from riskloom.operators import alerts as AL

SCHEMA = ("alert_key string, id string, transaction_id string, sender_id string, receiver_id string, amount double, risk_score int, "
          "risk_tier string, severity string, status string, reason string, timestamp string, assigned_to string, seq long")


def colliding():
    seen = {}
    for i in range(400_000):
        t = f"T{i}"
        h = hashlib.md5(t.encode()).hexdigest()[:8]
        if h in seen:
            return seen[h], t
        seen[h] = t
    raise AssertionError("no two keys share 32 bits")


def test_shared_short_id(spark):
    a, b = colliding()
    rows = [(t, t, f"ACC-{i}", "R", 1.0, 90, "Critical", "Critical", "Open", "r", "t", "Unassigned", i) for i, t in enumerate((a, b))]
    alerts = spark.createDataFrame([(r[0], "", *r[1:]) for r in rows], SCHEMA).withColumn("id", AL.hashed_alert_id("transaction_id"))
    assert alerts.select("id").distinct().count() == 1
    updates = spark.createDataFrame([("ACC-0", 5, "2020-01-01 02:00:00", "closed"), ("ACC-0", 9, "2020-01-01 01:00:00", "Escalated"), ("ACC-1", 7, "2020-01-01 03:00:00", "nonsense")],
                                    "account_id string, update_seq long, ts string, new_status string")
    updates = updates.withColumn("ts", F.to_timestamp("ts")).withColumn("notes", F.lit(None).cast("string")).withColumn("assigned_to", F.lit(None).cast("string"))
    routed, rejected = AL.route_updates(updates, alerts)
    valid, invalid = AL.validate_status(routed)
    assert rejected.count() == 0 and invalid.count() == 1
    after, logs = AL.apply_updates(alerts, valid)
    assert {r.transaction_id: (r.status, r.n_updates) for r in after.collect()} == {a: ("Closed", 2), b: ("Open", 0)}
    # log rows follow (ts, update_seq), not the update's own number
    assert [r.action for r in logs.orderBy("log_seq").collect()] == ["Changed status from Open to Escalated", "Changed status from Escalated to Closed"]
    again, more = AL.apply_updates(after, valid)
    assert more.agg(F.min("log_seq")).first()[0] > logs.agg(F.max("log_seq")).first()[0]
