import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.operators.alerts import materialize_alerts, opening_logs
from riskloom.operators.ml_stages import GovernanceStage
from riskloom.operators.preprocess import GovernancePreprocessor
from riskloom.operators.scoring import score_transactions
from riskloom.session import scratch_path
from riskloom.sources import snapshots as SN
from riskloom.sources.fixtures import feature_matrix, transactions
from riskloom.sources.tables import Tables

from .conftest import SF_SMALL


def test_a_saved_pipeline_gives_the_same_matrix(spark):
    fm = feature_matrix(Tables(spark, SF_SMALL)).limit(200).cache()
    fitted = GovernancePreprocessor().fit(fm, "F3924", exclude=["vec_id"])
    pipe = Pipeline(stages=[GovernanceStage(labelCol="F3924", keyCol="vec_id"), VectorAssembler(inputCols=fitted.numeric_features[:3], outputCol="v")])
    path = scratch_path(spark, "pipeline")
    pipe.write().save(path + "-unfitted")
    model = Pipeline.load(path + "-unfitted").fit(fm)
    model.write().save(path)
    loaded = PipelineModel.load(path)
    assert loaded.stages[0].fitted == fitted
    want = fitted.transform(fm)
    assert sorted(map(str, loaded.transform(fm).select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert loaded.transform(fm).select("v").first().v.size == 3


@pytest.fixture(scope="module")
def store(spark):
    alerts, _ = materialize_alerts(score_transactions(transactions(Tables(spark, SF_SMALL)).limit(300)))
    alerts = alerts.cache()
    return alerts, opening_logs(alerts)


def test_a_failed_write_leaves_the_old_snapshot(spark, store):
    alerts, logs = store
    base = scratch_path(spark, "alert-store")
    assert SN.current(spark, base) is None
    seeded, _ = SN.read(spark, base, seed=(alerts.limit(2), logs))
    assert seeded.count() == 2
    assert [f.count() for f in SN.read(spark, base)] == [0, 0]
    first = SN.commit(alerts, logs, base)
    reader, _ = SN.read(spark, base)
    broken = alerts.withColumn("status", F.when(F.col("seq") >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="lost"):
        SN.commit(broken, logs, base)
    assert SN.current(spark, base) == first
    assert SN.read(spark, base)[0].count() == alerts.count()
    second = SN.commit(alerts.limit(3), logs, base)
    assert SN.current(spark, base) == second != first
    assert SN.read(spark, base)[0].count() == 3
    assert reader.count() == alerts.count()  # a reader keeps its version
    SN.forget(spark, base, keep=[])
    assert SN.read(spark, base)[0].count() == 3
    SN.commit(alerts.limit(0), logs.limit(0), base)
    assert SN.read(spark, base, seed=(alerts.limit(1), logs))[0].count() == 1
