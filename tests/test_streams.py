"""Replayed micro-batches and failing reads of the stream sinks."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators.alerts import materialize_alerts
from riskloom.operators.scoring import score_transactions
from riskloom.session import scratch_path
from riskloom.sources.fixtures import alert_updates, transactions
from riskloom.sources.tables import Tables
from riskloom.streaming import scorecard_stream as ST
from riskloom.streaming import workflow_stream as WS

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def txn(spark):
    return transactions(Tables(spark, SF_SMALL)).limit(400).cache()


def test_a_replayed_batch_adds_nothing(spark, txn):
    path = scratch_path(spark, "sink")
    ST.create_sink(spark, path, ST.ALERT_STREAM_SCHEMA)
    write, batch = ST.alert_sink(path), ST.with_event_time(txn)
    write(batch, 0)
    n = spark.read.parquet(path).count()
    write(batch, 0)
    write(batch, 1)  # the same requests in a later batch
    assert 0 < n == spark.read.parquet(path).count()


def test_a_failed_read_fails_the_batch(spark, txn):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        ST.alert_sink(scratch_path(spark, "nowhere"))(ST.with_event_time(txn), 0)


def test_workflow_replay_order_and_compaction(spark, txn):
    alerts, _ = materialize_alerts(score_transactions(txn))
    updates = alert_updates(Tables(spark, SF_SMALL))
    base, new = scratch_path(spark, "store"), scratch_path(spark, "store")
    WS.open_store(alerts, base, updates)
    sink = WS.workflow_sink(base)
    late, early = updates.filter("update_seq % 2 = 0"), updates.filter("update_seq % 2 = 1")
    for batch_id, batch in ((0, late), (1, early), (0, late)):
        sink(batch, batch_id)
    once = scratch_path(spark, "store")
    WS.open_store(alerts, once, updates)
    WS.workflow_sink(once)(updates, 0)

    def state(b):
        a, logs = WS.current_state(spark, b)
        return sorted(map(tuple, a.collect())), sorted(map(tuple, logs.collect()))

    assert state(base) == state(once)
    WS.compact(spark, base, new)
    assert state(new) == state(once)
    assert spark.read.parquet(f"{base}/updates").filter(F.col("batch_id") >= 0).count() > 0


def test_a_batch_reads_only_folders_that_can_match(spark, txn, monkeypatch):
    path = scratch_path(spark, "sink")
    ST.create_sink(spark, path, ST.ALERT_STREAM_SCHEMA)
    write, timed = ST.alert_sink(path), ST.with_event_time(txn)
    write(timed.where("seq % 3 = 0"), 0)
    write(timed.where("seq % 3 = 1"), 1)
    read = []
    found = ST.possible_folders
    monkeypatch.setattr(ST, "possible_folders", lambda keys, filters: read.append(found(keys, filters)) or read[-1])
    write(timed.where("seq % 3 = 2"), 2)  # nothing of it is stored
    first = spark.read.parquet(path).where("batch_id = 0").select("transaction_id").first()[0]
    write(timed.where(F.col("transaction_id") == first), 3)
    size = {b: sum(int(f.getLen()) for f in files(spark, f"{path}/batch_id={b}")) for b in (0, 1, 2)}
    assert len(read[0]) <= 1 and len(read[1]) == 1 and read[1][0][0] == 0
    b, k = read[1][0]
    used = sum(int(f.getLen()) for f in files(spark, f"{path}/batch_id={b}/bucket={k}"))
    assert 0 < used < sum(size.values()) / 8
    rows = spark.read.parquet(path)
    assert rows.count() == rows.select("transaction_id").distinct().count()


def files(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    while found.hasNext():
        yield found.next()


def test_nothing_of_a_batch_is_broadcast_to_find_its_folders(spark, txn, monkeypatch):
    """A folder's filter is one row, and keys meet the filters in the tasks."""
    path = scratch_path(spark, "sink")
    ST.create_sink(spark, path, ST.ALERT_STREAM_SCHEMA)
    write, timed = ST.alert_sink(path), ST.with_event_time(txn)
    write(timed.where("seq % 2 = 0"), 0)
    filters = spark.read.schema(ST.FILTER_SCHEMA).parquet(ST.sink_filter(path))
    stored = spark.read.parquet(path).where("batch_id = 0").select("transaction_id", "bucket")
    folders = stored.select("bucket").distinct().count()
    assert filters.count() == filters.select("bucket").distinct().count() == folders > 1
    plans, collect = [], type(filters).collect
    monkeypatch.setattr(type(filters), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    keys = stored.orderBy("transaction_id").limit(1)
    asked = collect(keys)[0]
    assert ST.possible_folders(keys, filters) == [(0, asked.bucket)]
    assert ST.possible_folders(spark.createDataFrame([("no such", 0)], "transaction_id string, bucket int"), filters) == []
    assert plans and not any("Broadcast" in p for p in plans)


def test_keyed_state_equals_the_fold_and_replays(spark, txn):
    from riskloom.streaming import workflow_state as KS

    alerts, _ = materialize_alerts(score_transactions(txn))
    alerts = alerts.limit(12).cache()
    accounts = [r[0] for r in alerts.select("sender_id").distinct().collect()]
    updates = alert_updates(Tables(spark, SF_SMALL)).limit(60).withColumn(
        "account_id", F.element_at(F.array(*[F.lit(a) for a in accounts]), (F.col("update_seq") % len(accounts) + 1).cast("int"))).cache()
    base, src, ckpt = (scratch_path(spark, n) for n in ("state", "src", "ckpt"))
    KS.open_state(alerts, base)
    schema = updates.schema
    for part in (1, 0):  # the later half first
        updates.where(F.col("update_seq") % 2 == part).coalesce(1).write.mode("append").parquet(src)
        KS.run_state_stream(spark, src, schema, base, ckpt, "400 days")
    waiting = spark.read.parquet(f"{base}/applied").count()
    KS.close(spark, updates, src)
    for _ in range(2):  # the second run has nothing to do
        KS.run_state_stream(spark, src, schema, base, ckpt, "400 days")
    once = scratch_path(spark, "store")
    WS.open_store(alerts, once, updates)
    WS.workflow_sink(once)(updates, 0)
    want, want_logs = WS.current_state(spark, once)
    got, got_logs = KS.state_of(spark, base)
    cols = ["alert_key", "status", "assigned_to", "n_updates"]
    assert waiting == 0
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    names = ["alert_key", "log_seq", "action", "timestamp"]
    assert sorted(map(tuple, got_logs.select(names).collect())) == sorted(map(tuple, want_logs.where("log_seq > 0").select(names).collect()))
