import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import quality_cnn

from ..conftest import SF_SMALL
from . import brute


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, sf = docs.columns, SF_SMALL
    stage = dict(corpus_pipeline.STAGES)

    def keep(df):
        return spark.createDataFrame(df.collect(), df.schema)

    good = keep(stage["quality classifier"](spark, docs, sf))
    score = {r.doc_id: r.score for r in quality_cnn.score(docs, quality_cnn.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {i for i, s in score.items() if s >= 0.3}

    single = keep(stage["MinHash near-dedup"](spark, good, sf))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {min(rows[x][0] for x in s) for s in brute.near_duplicate_classes(rows)}

    fresh = keep(stage["benchmark decontamination"](spark, single, sf))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {i for i, _, h, _ in brute.contamination([(r.doc_id, r.text) for r in single.collect()], items) if h}
    assert {r.doc_id for r in fresh.collect()} == {r.doc_id for r in single.collect()} - hit

    safe = keep(stage["PII"](spark, fresh, sf))
    assert safe.columns == columns and safe.count() == fresh.count()
    before = {r.doc_id: r.text for r in fresh.collect()}
    for r in safe.collect():
        assert not [k for _, k, _ in brute.personal(r.text) if k == 0] and r.n_chars == len(r.text)
        assert brute.personal(before[r.doc_id]) or r.text == before[r.doc_id]

    last = stage["byte-level BPE encoding and decoding"](spark, safe, sf).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in safe.collect()}
    assert all(r.n_tokens == len(r.ids) for r in last)


def test_run_and_empty_table(spark, documents):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert 0 < got.count() < spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    empty = documents([])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF_SMALL)
        assert out.collect() == []


def test_a_column_called_score_keeps_its_values(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("score", F.col("doc_id") * 0.5).withColumn("own_1", F.lit("x"))
    kept = dict(corpus_pipeline.STAGES)["quality classifier"](spark, docs, SF_SMALL)
    assert kept.columns == docs.columns and kept.schema["score"].dataType == docs.schema["score"].dataType
    want = {r.doc_id: tuple(r) for r in docs.collect()}
    rows = kept.collect()
    assert rows and all(tuple(r) == want[r.doc_id] for r in rows)
