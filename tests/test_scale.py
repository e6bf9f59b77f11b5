"""Steps that once grew faster than their input: their results, and the bounds that hold now."""

import math

from pyspark.sql import functions as F

from riskloom.operators import isolation as IF
from riskloom.operators.flat_trees import FlatTrees


def _trees():
    t = FlatTrees(2, 2)
    t.split(0, 1, 0, 0.5)
    t.split(0, 3, 1, float("nan"))
    t.split(1, 1, 1, -1.0)
    for i in range(len(t.value)):
        t.value[i] = i + 0.25
    return t


def test_trees_are_walked_in_batches(spark):
    """One Python function walks all trees; null and NaN go right, a NaN threshold sends all else left (F1)."""
    t, nan = _trees(), float("nan")
    rows = [(0, [0.0, 0.0]), (1, [1.0, 2.0]), (2, [None, nan]), (3, [nan, None]), (4, [0.5, -3.0])]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    tree = F.explode(F.array(F.lit(0), F.lit(1)))
    by_node = df.withColumn("tree", tree).select("i", "tree", t.leaf(F.col("x"), F.col("tree")).alias("node")).collect()
    want = {i: sum(t.value[t.at(r.tree, r.node)] for r in by_node if r.i == i) for i, _ in rows}
    got = df.select("i", t.total(F.col("x")).alias("v"))
    assert {r.i: r.v for r in got.collect()} == want
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()


def test_training_scores_come_with_the_forest(spark):
    """The rows are scored once: the scores behind the offset are those that ``score`` gives (F1)."""
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 37).cast("double").alias("a"), F.sqrt("id").alias("b"))
    model, scores = IF.fit_scored(df, ["a", "b"], "k", n_trees=10, psi=64)
    again = {r.k: r.score for r in IF.score(df, model, "k").collect()}
    assert {r.k: r.score for r in scores.collect()} == again and len(again) == 400


def test_the_sample_of_a_tree_is_that_of_its_hashes(spark):
    """Comparing hex digits draws the same rows as comparing fractions (F1)."""
    from riskloom.operators.alerts import hash_fraction
    n, psi, trees = 5000, 16, 3
    df = spark.range(n).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a"))
    got = {(r.tree, r.x[0]) for r in IF.sample(df, ["a"], "k", n, trees, psi).collect()}
    share = (2.0 * psi + 100.0) / n
    want = set()
    for t in range(trees):
        key = F.concat_ws("|", F.col("k").cast("string"), F.lit(str(t)), F.lit("42"))
        want |= {(t, float(r.k)) for r in df.where(hash_fraction(key) < share).orderBy(F.md5(key), "k").limit(psi).collect()}
    assert got == want and math.isclose(len(got), trees * psi)


def test_a_level_of_boosting_has_no_tasks_of_a_few_rows(spark, monkeypatch):
    """Every level is a job: small training tables are not spread over many tasks."""
    from riskloom.operators import boosting as BO
    seen, grow = [], BO.grow
    monkeypatch.setattr(BO, "grow", lambda rdd, *a: seen.append(rdd.getNumPartitions()) or grow(rdd, *a))
    df = spark.range(600).repartition(16).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 10 > 6).cast("int").alias("y"))
    model = BO.fit(df, ["a"], "y", "k", BO.Settings(trees=2, depth=2))
    assert seen == [1, 1] and model.history[0].nodes[1].count == 600


def test_spans_in_numpy_are_those_of_sql(spark):
    """Least and greatest values of a node and feature: null is no value, NaN the greatest."""
    from riskloom.operators import random_trees as RT
    nan = float("nan")
    rows = [([1.0, None], 1), ([2.0, nan], 0), ([-0.5, 3.0], 1), ([nan, 4.0], None), ([7.0, None], 0), ([nan, None], 1)]
    df = spark.createDataFrame(rows, "x array<double>, y bigint").repartition(3)
    t = FlatTrees(2, 2)
    t.split(1, 1, 0, 1.5)
    for depth in (0, 1):
        members = df.select("x", "y", F.explode(F.array(F.lit(0), F.lit(1))).alias("tree"))
        want = RT._level(members, t, depth).select("tree", "node", F.coalesce("y", F.lit(0)).alias("y"), F.posexplode("x").alias("feature", "v")).groupBy("tree", "node", "feature").agg(
            F.count("*").alias("n"), F.sum("y").alias("positive"), F.min("v").alias("low"), F.max("v").alias("high"))
        got = RT._spans_of_all(df, t, depth, 2)
        both = [sorted(repr(tuple(r)) for r in f.select("tree", "node", "feature", "n", "positive", "low", "high").collect()) for f in (want, got)]
        # a feature of NaN alone has no least value here; neither is a candidate
        usable = [[r for r in b if "nan, nan" not in r and "None, nan" not in r] for b in both]
        assert usable[0] == usable[1] and usable[0]


def _explained(spark):
    from riskloom.operators import attribution as AT
    from riskloom.operators.column_models import LinearModel

    model = LinearModel([f"a{i}" for i in range(10)], [(i - 4) / 3.0 for i in range(10)], 0.1)
    df = spark.range(30).select(F.col("id").cast("string").alias("k"), *[((F.col("id") * (i + 2)) % 7).cast("double").alias(f"a{i}") for i in range(10)])
    bg = AT.background_from_data(df, model)
    return AT, AT.explain(df, model, bg, "k"), bg


def test_a_waterfall_is_one_pass(spark):
    """Base, steps and final come from one explode, not from a union of three passes."""
    AT, ex, bg = _explained(spark)
    w = AT.waterfall(ex, bg, top_k=8)
    assert "Union" not in w._jdf.queryExecution().optimizedPlan().toString()
    rows = w.where("row_id = '3'").orderBy("step").collect()
    assert [r.step for r in rows] == list(range(11)) and [r.type for r in (rows[0], rows[-1])] == ["base", "total"]
    assert rows[9].feature == "Other (2 marginal features)" and abs(rows[9].cumulative - rows[10].cumulative) < 1e-9


def test_ranges_come_with_the_importance(spark):
    """One pass gives importance and ranges; the points are those of ranges taken apart (F8)."""
    AT, ex, _ = _explained(spark)
    long = AT.attribution_long(ex)
    stats = AT.feature_stats(long)
    got, want = [sorted(map(tuple, b.collect())) for b in (AT.beeswarm(long, AT.top_features(stats, 4), stats), AT.beeswarm(long, AT.top_features(AT.global_importance(long), 4)))]
    assert got == want and len(got) == 120


def test_probes_leave_in_pieces(spark, monkeypatch):
    """The neighbours do not depend on how many probes or rows a task holds at a time."""
    from riskloom.operators import smote as SM
    pts = spark.range(1, 601).select(F.col("id").alias("pick"), F.array(*[F.rand(i) for i in range(6)]).alias("v")).checkpoint()
    want = sorted(map(tuple, SM.knn_minority(pts, 600, 6, 3).collect()))
    monkeypatch.setattr(SM, "PROBES", 5)
    monkeypatch.setattr(SM, "PLACED", 7)
    assert sorted(map(tuple, SM.knn_minority(pts, 600, 6, 3).collect())) == want and len(want) == 1800


def _alerts(spark, n, seen=None):
    from riskloom.sources import io as IO
    mark = F.udf(lambda s: (seen.add(1) if seen is not None else None) or s, "string")
    row = {"alert_key": F.concat(F.lit("T"), "id"), "risk_score": F.lit(90), "amount": F.lit(1.0), "seq": F.col("id"), "sender_id": mark(F.concat(F.lit("ACC-"), F.col("id").cast("string")))}
    cols = [c.split() for c in IO.ALERT_SCHEMA.split(", ")]
    return spark.range(n).select(*[row.get(c, F.lit(c)).cast(t).alias(c) for c, t in cols])


def test_snapshots_are_compressed(spark):
    """JSON lines of a snapshot are gzipped, and read back whole."""
    from riskloom.operators.alerts import opening_logs
    from riskloom.session import scratch_path
    from riskloom.sources import io as IO
    alerts, path = _alerts(spark, 50), scratch_path(spark, "snap")
    IO.write_alert_snapshot(alerts, opening_logs(alerts), path)
    back, logs = IO.read_alert_snapshot(spark, path)
    assert all(f.endswith(".json.gz") for f in [*back.inputFiles(), *logs.inputFiles()])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, alerts.collect())) and logs.count() == 50


def test_the_opening_store_is_built_once(spark):
    """The logs and the empty log of updates come from the alerts as written."""
    from riskloom.session import scratch_path
    from riskloom.streaming import workflow_stream as WS
    seen = spark.sparkContext.accumulator(0)
    updates = spark.createDataFrame([], "account_id string, update_seq bigint, ts timestamp, event_type string, new_status string, notes string, assigned_to string")
    base = scratch_path(spark, "store")
    WS.open_store(_alerts(spark, 40, seen), base, updates)
    assert seen.value == 40 and spark.read.parquet(f"{base}/logs").count() == 40


def test_requests_are_kept_narrow(spark, monkeypatch):
    """What is checkpointed leaves out features and attributions."""
    from riskloom.plans import catalog as C
    from .conftest import SF_SMALL
    seen, make = [], C.AL.materialize_alerts
    monkeypatch.setattr(C.AL, "materialize_alerts", lambda s, *a: seen.append(set(s.columns)) or make(s, *a))
    assert C.QUERIES["alerts_against_store"](spark, SF_SMALL).count() == 2
    assert seen and not any({"attributions", "features", "custom_metrics"} & s for s in seen)


def test_small_files_share_a_micro_batch(spark):
    """Batches go by bytes, and a folder of the sink is one file."""
    from glob import glob

    from riskloom.plans.catalog import transactions
    from riskloom.session import scratch_path
    from riskloom.sources.tables import Tables
    from riskloom.streaming import scorecard_stream as ST

    from .conftest import SF_SMALL
    src, sink = scratch_path(spark, "small-src").removeprefix("file:"), scratch_path(spark, "small-sink").removeprefix("file:")
    transactions(Tables(spark, SF_SMALL)).repartition(10).write.parquet(src)
    ST.run_alert_stream(spark, src, spark.read.parquet(src).schema, sink, delay="4000 days")
    batches = [f for b in glob(f"{sink}/batch_id=*") for f in [b] if glob(f"{b}/bucket=[0-9]*/*.parquet")]
    assert len(batches) == 1 and all(len(glob(f"{f}/*.parquet")) == 1 for f in glob(f"{batches[0]}/bucket=[0-9]*"))


def test_an_alert_opens_with_its_first_request():
    """No state is made for alerts that no request names."""
    from riskloom.streaming import workflow_state as KS
    assert "handleInitialState" not in vars(KS.AlertWorkflow)


def test_draws_take_no_digest_object_for_each_row_and_tree(spark):
    """The digests of a batch are taken in numpy, and they are Spark's md5, whatever the ids (F1)."""
    ids = [None, "", "é" * 30, "x" * 55, "x" * 56, "y" * 130, *map(str, range(3000))]
    df = spark.createDataFrame([(i, float(n)) for n, i in enumerate(ids)], "k string, a double")
    n, psi, trees = len(ids), 700, 3
    got = IF.sample(df, ["a"], "k", n, trees, psi)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    want = set()
    for t in range(trees):
        key = F.concat_ws("|", "k", F.lit(str(t)), F.lit("42"))
        want |= {(t, r.a) for r in df.orderBy(F.md5(key), "k").limit(psi).collect()}
    assert {(r.tree, r.x[0]) for r in got.collect()} == want


def test_walking_below_leaves_gives_their_values(spark):
    """Leaves at any depth, a NaN threshold, and null, NaN and infinite features (F1)."""
    t = FlatTrees(2, 3)
    t.split(0, 1, 0, 0.5)
    t.split(0, 3, 1, float("nan"))
    t.split(0, 7, 0, float("inf"))
    t.split(1, 1, 1, -1.0)
    t.value = [float(i) for i in range(len(t.value))]
    values = [None, float("nan"), float("inf"), float("-inf"), -2.0, 0.0, 0.5, 3.0]
    df = spark.createDataFrame([(i, [a, b]) for i, (a, b) in enumerate((a, b) for a in values for b in values)], "i int, x array<double>")
    got = {r.i: r.v for r in df.select("i", t.total(F.col("x")).alias("v")).collect()}
    each = df.withColumn("tree", F.explode(F.array(F.lit(0), F.lit(1)))).select("i", "tree", t.leaf(F.col("x"), F.col("tree")).alias("node")).collect()
    want = dict.fromkeys(got, 0.0)
    for r in each:
        want[r.i] += t.value[t.at(r.tree, r.node)]
    assert got == want


def test_transactions_with_anomaly_are_joined_once(spark, monkeypatch):
    """What is scored comes from the rows as written, not from the joins again (F1)."""
    from riskloom.plans import catalog as C
    plans, score = [], C.score_transactions
    monkeypatch.setattr(C, "score_transactions", lambda df, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or score(df, **k))
    C.QUERIES["scorecard_with_anomaly"](spark, "/root/testdata/sf0.001").collect()
    assert len(plans) == 1 and "l_orderkey" not in plans[0]
