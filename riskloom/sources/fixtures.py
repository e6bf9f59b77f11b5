"""Derived inputs built from the given tables (FIXTURES.md §C).

* ``transactions`` (C1): one scoring payload per order.
* ``feature_matrix`` (C2): the embedding table widened to F0..F63 plus the
  injected-fault columns of the governance demo.
* ``alert_updates`` (C4): workflow events derived from ``events``.

Plan shape for ``transactions`` at scale: lineitem is aggregated by order key
(partial aggregation before the shuffle), orders are shuffled once by order
key to meet it, and the per-customer first-order date is a ``groupBy`` +
join rather than a window; the join is salted, so a customer that owns a
third of all orders is spread over several tasks.  The supplier lookup is a
plain equi-join; AQE turns such joins into broadcasts only when the measured
side is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.skew import salted_join
from .tables import Tables

# metric name -> expression over the per-order line aggregate
TXN_METRICS = ["F115", "F321", "F527", "F670"]


def order_lines(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.min("l_suppkey").alias("min_suppkey"),
        F.avg("l_discount").alias("avg_discount"),
        F.avg("l_tax").alias("avg_tax"),
        F.sum("l_quantity").alias("sum_quantity"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
    )


def _country(nationkey: str):
    codes = F.array(*[F.lit(c) for c in K.FIXTURE_COUNTRIES])
    return F.try_element_at(codes, F.col(nationkey) + F.lit(1))


def transactions(t: Tables) -> DataFrame:
    """Payload columns of D3 plus ``seq``, ``ts`` and the label ``F3924``.

    ``origin_country``/``destination_country`` stay NULL where the fixture has
    no value; payload defaulting (P1) happens in the scorer, as in the
    reference request model.
    """
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    cust = t.customer.select(F.col("c_custkey"), _country("c_nationkey").alias("origin_country"))
    supp = t.supplier.select(F.col("s_suppkey"), _country("s_nationkey").alias("destination_country"))
    first = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order_ts"))

    known = first.join(cust, first["o_custkey"] == cust["c_custkey"], "left").drop("c_custkey")
    by_cust = salted_join(o, known, "o_custkey", "o_orderkey", "left")
    lines = order_lines(t)
    j = (
        by_cust.join(lines, by_cust["o_orderkey"] == lines["l_orderkey"], "left")
        .join(supp, F.col("min_suppkey") == supp["s_suppkey"], "left")
    )
    has_lines = F.col("n_lines").isNotNull()
    metrics = F.create_map(
        F.lit("F115"), (F.col("n_lines") - F.lit(4)) / F.lit(2.0),
        F.lit("F321"), F.col("avg_discount") * F.lit(10.0) - F.lit(0.5),
        F.lit("F527"), F.col("avg_tax") * F.lit(10.0) - F.lit(0.4),
        F.lit("F670"), F.col("sum_quantity") / F.lit(100.0) - F.lit(1.0),
    )
    origin = F.coalesce(F.col("origin_country"), F.lit(K.DEFAULT_COUNTRY))
    return j.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("TXN-"), F.col("o_orderkey").cast("string")).alias("transaction_id"),
        F.concat(F.lit("ACC-"), F.col("o_custkey").cast("string")).alias("sender_id"),
        F.when(has_lines, F.concat(F.lit("SUP-"), F.col("min_suppkey").cast("string"))).alias("receiver_id"),
        (F.col("o_totalprice") * F.lit(0.4)).alias("amount"),
        F.col("origin_country"),
        F.col("destination_country"),
        F.datediff(F.to_date("o_orderdate"), F.to_date("first_order_ts")).cast("bigint").alias("account_age_days"),
        (origin != F.coalesce(F.col("destination_country"), F.lit(K.DEFAULT_COUNTRY))).alias("is_international"),
        F.col("o_orderdate").alias("ts"),
        F.when(has_lines, metrics).alias("custom_metrics"),
        F.when(has_lines, (F.lit(3) * F.col("n_returned") >= F.lit(2) * F.col("n_lines")).cast("int"))
        .otherwise(F.lit(0)).alias(K.TARGET_COLUMN),
    )


def feature_matrix(t: Tables, with_faults: bool = True) -> DataFrame:
    """Embeddings → F0..F63 doubles, target ``F3924 = (label = 0)``.

    The fault columns mirror the governance demo: one mostly-missing, one
    constant, a near-copy of the target, a name leak, a collinear pair, a
    categorical separator, a strongly predictive column, a harmless
    categorical, and a numeric and a text column whose gaps are NaN and
    'nan' / 'None'.  Noise is deterministic so the SQL oracle can rebuild it.
    """
    e = t.embeddings
    y = (F.col("label") == 0).cast("int")
    dims = [F.col("embedding")[i].cast("double").alias(f"F{i}") for i in range(64)]
    base = e.select(F.col("vec_id"), y.alias(K.TARGET_COLUMN), *dims)
    if not with_faults:
        return base
    yv = F.col(K.TARGET_COLUMN).cast("double")
    return base.select(
        "*",
        F.when(F.col("vec_id") % 10 < 4, F.col("F5")).alias("F12_excess_missing"),
        F.lit(3.924).alias("F34_constant"),
        (yv + F.lit(1e-4) * F.col("F2")).alias("F56_leak_target"),
        yv.alias("F3924_derived_rule"),
        (F.lit(1.5) * F.col("F1")).alias("F_collinear_a"),
        (F.lit(1.5) * F.col("F1") + F.lit(1e-3) * F.col("F2")).alias("F_collinear_b"),
        F.when(yv == 1, F.lit("FLAG_APPROVED")).otherwise(F.lit("FLAG_PENDING")).alias("F_cat_deterministic_leak"),
        F.concat(F.lit("C"), (F.col("vec_id") % 3).cast("string")).alias("F_cat_ok"),
        (F.lit(2.0) * yv + F.col("F3")).alias("F_highly_predictive"),
        F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("F6")).alias("F_nan_holes"),
        F.when(F.col("vec_id") % 5 == 0, F.lit("nan")).when(F.col("vec_id") % 5 == 1, F.lit("None"))
        .otherwise(F.concat(F.lit("D"), (F.col("vec_id") % 2).cast("string"))).alias("F_cat_nan_text"),
    )


UPDATE_STATUS = {"view": "Investigating", "error": "Escalated", "purchase": "Closed"}


def alert_updates(t: Tables) -> DataFrame:
    """C4: ``events`` as workflow update requests (D6), keyed by account.

    ``user_id`` u addresses account ``ACC-<13u+1>`` (some have no alert); the workflow operator routes
    the request to that account's newest alert (J1) and rejects it when the
    account has none.  Event types map to statuses (view → Investigating,
    error → Escalated, purchase → Closed); ``click`` and ``signup`` keep the
    current status, ``click``/``error`` add a note and ``signup`` re-assigns.
    One event id in 97 asks for a status that doesn't exist and is to be rejected.
    Updates apply in ``(ts, event_id)`` order.
    """
    ev = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    status = F.coalesce(
        F.when(F.col("event_id") % 97 == 5, F.lit("archived")),
        *[F.when(F.col("event_type") == k, F.lit(v)) for k, v in UPDATE_STATUS.items()],
        F.lit(None).cast("string"),
    )
    return ev.select(
        F.concat(F.lit("ACC-"), (F.col("user_id") * F.lit(13) + F.lit(1)).cast("string")).alias("account_id"),
        F.col("event_id").alias("update_seq"),
        F.col("ts"),
        F.col("event_type"),
        status.alias("new_status"),
        F.when(F.col("event_type").isin("click", "error"),
               F.concat(F.lit("Event "), F.col("event_type"), F.lit(" value "), F.format_number("value", 2)))
        .alias("notes"),
        F.when(F.col("event_type") == "signup",
               F.concat(F.lit("Analyst "), (F.col("user_id") % F.lit(7)).cast("string")))
        .alias("assigned_to"),
    )


# order priority -> status text of a legacy alert feed; '5-LOW' carries a
# status the store does not know, so those requests are rejected (P25)
INGEST_STATUS = {"1-URGENT": "escalated", "2-HIGH": "investigating", "3-MEDIUM": "OPEN",
                 "4-NOT SPECIFIED": "closed", "5-LOW": "pending"}


def ingest_requests(t: Tables) -> DataFrame:
    """Manual alert-ingest requests (A6) derived from ``orders``.

    Score is ``floor(o_totalprice) mod 101``; finished orders (status F) carry
    an explicit tier, the others leave tier/severity to be derived.
    """
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    status = F.coalesce(*[F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in INGEST_STATUS.items()])
    return o.select(
        F.concat(F.lit("LEG-"), F.col("o_orderkey").cast("string")).alias("transaction_id"),
        F.concat(F.lit("ACC-"), F.col("o_custkey").cast("string")).alias("sender_id"),
        F.lit(None).cast("string").alias("receiver_id"),
        F.col("o_totalprice").alias("amount"),
        (F.floor("o_totalprice") % F.lit(101)).cast("int").alias("risk_score"),
        F.when(F.col("o_orderstatus") == "F", F.lit("High")).alias("risk_tier"),
        F.lit(None).cast("string").alias("severity"),
        status.alias("status"),
        F.lit(None).cast("string").alias("reason"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.col("o_orderkey").alias("seq"),
    )
