from pyspark.sql import functions as F

from riskloom.llm import decontam, queries

from ..conftest import SF_SMALL
from . import brute

ITEM = "One two three FOUR five six seven eight nine ten eleven twelve"


def shown(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()), key=str)


def check(spark, documents, docs, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contaminate(documents(docs), bench)
    assert shown(got) == sorted(brute.contamination(docs, items), key=str)
    assert all(r.contaminated == (r.n_hit > 0) for r in got.collect())


def test_windows_borders_and_case(spark, documents):
    w = ITEM.split()
    check(spark, documents, [
        (1, ITEM), (2, " ".join(w[:10])), (3, " ".join(w[:9])), (4, "x " + " ".join(w[2:]) + " y"), (5, " ".join(w[::-1])),
        (6, "a, b; " + ", ".join(w).lower() + "!"), (7, ITEM + " " + ITEM), (8, "short one"), (9, "a short one b short one"), (10, "Ünï"), (11, "x ünï")],
        [(1, ITEM), (2, "short ONE"), (3, "ünï"), (4, ITEM), (5, "one two three four five six seven eight nine ten")])


def test_nulls_empty_repeats_and_hot_passages(spark, documents):
    docs = [(1, None), (2, ""), (3, "..."), (4, ITEM), (4, ITEM), (4, "other text"), (None, ITEM), (None, None)]
    docs += [(i, f"doc{i} {ITEM} end{i}") for i in range(100, 160)] + [(200, (ITEM + " filler ") * 500)]
    check(spark, documents, docs, [(1, ITEM), (2, None), (3, ""), (None, ITEM), (4, ITEM)])


def test_empty_tables_and_other_columns(spark, documents):
    check(spark, documents, [], [(1, ITEM)])
    check(spark, documents, [(1, ITEM)], [])
    bench = spark.createDataFrame([(1, ITEM, 5)], "item_id bigint, text string, doc_id int")
    docs = documents([(1, ITEM)]).withColumn("item_id", F.lit(9)).withColumn("win", F.lit("x"))
    assert shown(decontam.contaminate(docs, bench)) == [(1, 12, 12, ["1"])]


def test_decontaminated_keeps_clean_rows_and_columns(spark, documents):
    docs = documents([(1, ITEM), (2, "clean"), (3, None), (2, "clean"), (None, "no id")])
    kept = decontam.decontaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id bigint, text string"))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "clean"), (2, "clean"), (3, None), (None, "no id")], key=str)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    want = sorted((i, n, h, len(x), brute.sha(",".join(x)), h > 0) for i, n, h, x in brute.contamination(docs, items))
    assert sorted(map(tuple, queries.op3_decontamination(spark, SF_SMALL).collect())) == want
