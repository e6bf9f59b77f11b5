import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import queries, topk

from ..conftest import SF_SMALL

SCHEMA = "vec_id bigint, embedding array<float>, rank int"


def brute(rows, k=5, every=50):
    usable = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), key=[len(v) for _, v in usable].count, default=0)
    scaled = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in usable if len(v) == width]
    out, asked = [], set()
    for q, v in sorted(scaled, key=lambda x: (x[0], x[1].tolist())):
        if q % every == 0 and q not in asked:
            asked.add(q)
            found = sorted((-int(v @ w), i) for i, w in scaled if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def check(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, **kwargs)
    assert sorted(map(tuple, got.collect())) == brute(rows, **kwargs)


def test_random_and_clustered(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(700)]
    center = rng.standard_normal(16)
    rows += [(1000 + i, (center + 0.01 * rng.standard_normal(16)).tolist()) for i in range(300)]
    check(spark, rows)
    check(spark, rows, k=1)


def test_ties_copies_nulls_and_odd_vectors(spark):
    same = [0.5, -0.25, 0.0]
    rows = [(i, same) for i in range(0, 400)] + [(401, None), (402, []), (450, [0.1, None, 0.2]), (500, [float("nan"), 0.0, 1.0]), (550, [float("inf"), 0.0, 0.0]),
                                                  (None, same), (600, [0.0, 0.0, 0.0]), (650, [1.0, 2.0]), (601, [9.0, 9.0, 9.0]), (601, [9.0, 9.0, 9.0]), (700, same), (700, same)]
    check(spark, rows)


def test_few_and_no_rows(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [3.0, 4.0])])
    check(spark, [(0, [1.0, 2.0])])
    check(spark, [])


def test_a_block_stops_early_when_one_group_stands_out():
    rng = np.random.default_rng(2)
    rows = rng.integers(-20, 20, (2000, 8))
    rows[:5] = 250
    place, ids, scores = topk.SortedBlock(np.arange(2000), rows).best(np.array([-1]), np.full((1, 8), 100), 5)
    assert place.tolist() == [0] * 5 and ids.tolist() == [0, 1, 2, 3, 4] and scores.tolist() == [200000] * 5


def test_blocks_against_full_products():
    rng = np.random.default_rng(3)
    for rows, queries in ((rng.integers(-60, 60, (3000, 64)), rng.integers(-60, 60, (40, 64))), (rng.integers(-2 ** 20, 2 ** 20, (1000, 16)), rng.integers(-2 ** 20, 2 ** 20, (9, 16))),
                          (np.repeat(rng.integers(-9, 9, (30, 6)), 50, axis=0), rng.integers(-9, 9, (20, 6)))):
        ids = rng.permutation(len(rows) * 2)[:len(rows)]
        asked = ids[:len(queries)].copy()
        place, found, scores = topk.SortedBlock(ids, rows).best(asked, queries, 5)
        got = sorted(zip(place.tolist(), (-scores).tolist(), found.tolist()))
        want = []
        for q in range(len(queries)):
            want += [(q, s, i) for s, i in sorted((int(-s), int(i)) for s, i in zip(rows @ queries[q], ids) if i != asked[q])[:5]]
        assert got == sorted(want)


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op6_topk(spark, SF_SMALL).collect())) == brute(rows)


def test_queries_are_not_broadcast_for_every_block(spark, monkeypatch):
    """Queries meet each block in the tasks; only the numbers of the blocks are broadcast (F1)."""
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(8) * 10 ** (i % 4)).tolist()) for i in range(1000)]  # blocks of values in 32 bits
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin BuildRight, Cross" in plan
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_packed_rows_come_back(spark):
    for x in (3, 40_000, 2 ** 40):
        df = spark.createDataFrame([(i, [x, -x, i]) for i in range(25)], "vec_id bigint, v array<bigint>").coalesce(1)
        packed = topk._packed(df, 10).toArrow()
        parts = [topk._unpacked(a, b, 3) for a, b in zip(packed.column("ids"), packed.column("flat"))]
        assert [len(ids) for ids, _ in parts] == [10, 10, 5] and len(set(packed.column("block").to_pylist())) == 3
        assert np.concatenate([v for _, v in parts]).tolist() == [[x, -x, i] for i in range(25)]
