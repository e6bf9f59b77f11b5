import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riskloom.llm import importance, queries
from riskloom.llm.wordscan import scan

from ..conftest import SF_SMALL


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(w):
    return [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, bench):
    def buckets(t):
        return [zlib.crc32(f.encode()) % 10000 for f in runs(words_of(t))]

    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, bench)):
        for x in texts:
            for b in buckets(x):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for i, x in docs:
        at = buckets(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in at)
        rows.append([i, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    in_draw = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(in_draw[:len(in_draw) * 5 // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def resampled(spark, documents, docs, bench):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id bigint, text string")
    return sorted(map(tuple, importance.resample(documents(docs).withColumn("score", F.lit("x")).withColumn("row", F.lit(1)), target).collect()), key=str)


def test_crc_of_joined_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcXYZ01 é日\n.") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["x" * 70_000 + " tail end", "", "one"]
    buckets, owner = importance.features(scan(pa.array(texts)), importance.Crc())
    for i, t in enumerate(texts):
        assert sorted(buckets[owner == i]) == sorted(zlib.crc32(f.encode()) % 10000 for f in runs(words_of(t)))


def test_against_brute_force(spark, documents):
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(60)]
    docs = [(rng.randint(-50, 400), " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for _ in range(500)]
    docs = [*{i: (i, t) for i, t in docs}.values()]
    docs += [(9001, None), (9002, ""), (9003, "W1 " * 40_000), (9004, ",. \n"), (None, " ".join(pool)), (9005, "É é İ ß 日本 " * 9)]
    bench = [" ".join(rng.choices(pool[:20], k=30)) for _ in range(10)] + [None, "", "W1 w2"]
    assert resampled(spark, documents, docs, bench) == brute(docs, bench)


def test_repeated_rows_and_no_target(spark, documents):
    docs = [(i % 7, "same words here again and again " * 5) for i in range(200)]
    assert resampled(spark, documents, docs, []) == brute(docs, [])


def test_no_rows(spark, documents):
    assert resampled(spark, documents, [], ["some words"]) == []


def test_radix_ranks_of_any_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 0, -5, 3, rng.randint(-10**9, 10**15)]), rng.choice([1, 1, 1, rng.randint(0, 10**6)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, id bigint").repartition(7)
    for digit, block in ((12, 1 << 14), (5, 64)):
        got = importance.radix_ranks(df, [("b", True), ("a", False), ("id", False)], digit, block).collect()
        want = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or 0, r[2]))
        assert [(r.a, r.b, r.id) for r in sorted(got, key=lambda r: r.place)] == want
        assert sorted(r.place for r in got) == list(range(len(rows)))


def test_a_block_is_all_a_task_holds(spark):
    same = spark.range(5000).select(F.lit(1).cast("long").alias("a"), F.col("id"))
    got = importance.radix_ranks(same, [("a", True)], block=256)
    assert np.array_equal(np.sort([r.place for r in got.collect()]), np.arange(5000))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op12_importance_resampling(spark, SF_SMALL).collect()), key=str) == brute(docs, bench)
