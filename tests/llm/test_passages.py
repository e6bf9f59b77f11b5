import random

import numpy as np
import pyarrow as pa

from riskloom.llm import passages
from riskloom.llm.wordscan import scan, shingles

from ..conftest import SF_SMALL
from . import brute


def words(rng, n):
    return [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]


def test_compact_windows_cover_every_stretch_once():
    rng = np.random.default_rng(1)
    for n, high in ((40, 1 << 60), (60, 3)):
        values = rng.integers(0, high, n).astype(np.uint64) << np.uint64(3)
        lo, at, hi = passages.compact_windows(values, np.array([0, n]), 5)
        for i in range(n):
            for j in range(i + 5, n + 1):
                holds = [(a, p, b) for a, p, b in zip(lo, at, hi) if a <= i <= p < j <= b]
                assert len(holds) == 1 and values[holds[0][1]] >> np.uint64(7) == values[i:j].min() >> np.uint64(7)


def test_passages_are_found_and_clean_documents_left_alone(documents):
    rng = random.Random(2)
    p, q = words(rng, 55), words(rng, 120)
    edited = list(q)
    for at in (30, 90):
        edited[at] = "edited"
    docs = {i: words(rng, 150) for i in range(30)}
    for i in (3, 4, 5, 6, 7):
        docs[i][40:40] = p
    docs[20][10:10], docs[21][100:100] = q, edited
    docs[25] = docs[26][:45] + docs[25]  # too short a passage
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(100, None), (101, ""), (102, "same words " * 400), (None, " ".join(p)), (103, "x " * 30)]
    got = passages.repeats(documents(rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "k")).collect()
    assert {r.doc_id for r in got} == {3, 4, 5, 6, 7, 20, 21}
    by = {r.doc_id: r for r in got}
    assert (by[5].start, by[5].n_words, by[5].class_doc_id, by[5].class_start) == (40, 55, 3, 40)
    assert by[21].class_doc_id == 20 and by[21].n_words >= 100 and by[21].similarity >= 0.8


def test_a_hot_passage_is_no_square(documents):
    rng = random.Random(4)
    p = words(rng, 60)
    docs = [(i, " ".join(words(rng, 20) + p + words(rng, 20))) for i in range(400)]
    got = passages.repeats(documents(docs)).collect()
    assert {r.doc_id for r in got} == set(range(400)) and len(got) < 1000


def test_copies_repeated_ids_and_empty_tables(documents):
    rng = random.Random(6)
    text = " ".join(words(rng, 200))
    rows = [(1, text), (1, text), (2, text), (3, " ".join(words(rng, 200)))]
    assert {r.doc_id for r in passages.repeats(documents(rows)).collect()} == {1, 2}
    assert passages.repeats(documents([(1, text), (1, text)])).collect() == []
    assert passages.repeats(documents([])).collect() == []


def test_small_tables(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id for r in passages.repeats(df).collect()}
    assert brute.repeated_words(docs, 51) <= got
    near = {i for s in brute.near_duplicate_classes(docs, 0.5) if len(s) > 1 for i in (docs[x][0] for x in s)}
    assert got - near <= brute.repeated_words(docs, 40)


def test_earlier_quotes_hide_no_repeat(documents):
    rng = random.Random(9)
    docs = {}
    for n in range(40):  # a quote, another quote between, and two documents with the whole passage
        p = words(rng, 60)
        for i, w in enumerate((p[:45], p, p[8:53], p, p[15:])):
            docs[10 * n + i] = words(rng, 100) + w + words(rng, 100)
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    got = passages.repeats(documents(rows)).collect()
    assert brute.repeated_words(rows, passages.WORDS) <= {r.doc_id for r in got}
    assert {r.doc_id for r in got} == {10 * n + i for n in range(40) for i in (1, 3)}
    held = {}
    for r in got:
        assert r.class_doc_id == r.doc_id // 10 * 10 + 1 and r.start >= 100 and r.start + r.n_words <= 160
        held.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    assert all(len(h) == 60 for h in held.values())


def test_repetitive_repeats_are_found(documents):
    rng = random.Random(10)
    rows = []
    for n in range(20):
        p = words(rng, rng.randrange(5, 12)) * 12
        rows += [(10 * n + i, " ".join(words(rng, rng.randrange(90, 110)) + w + words(rng, 100))) for i, w in enumerate((p[:48], p[:55], p[:58]))]
    got = {r.doc_id for r in passages.repeats(documents(rows)).collect()}
    assert brute.repeated_words(rows, passages.WORDS) <= got


def edited(rng, p, edits):
    """``p`` with single words replaced, removed or put in, far enough from each other for a similarity of 0.8."""
    p, step = list(p), len(p) // (edits + 1)
    for n in range(edits, 0, -1):
        at = n * step + rng.randrange(-3, 4)
        p[at:at + rng.choice((0, 1, 1))] = rng.choice(([], ["edited"], ["edited"])) or ["put"]
    return p


def test_earlier_quotes_hide_no_edited_passage(documents):
    rng = random.Random(11)
    docs, want = {}, set()
    for n in range(150):  # quotes of both ends before and between two versions of a passage
        edits, length = ((1, 80), (1, 62), (2, 125))[n % 3]
        p = words(rng, length)
        q = edited(rng, p, edits)
        for i, w in enumerate((p[:45], p[-45:], p, q[:45], q[-45:], p[8:53], q)):
            docs[10 * n + i] = words(rng, rng.randrange(60, 120)) + w + words(rng, 100)
        want |= {10 * n + 2, 10 * n + 6}
    rows = passages.repeats(documents([(i, " ".join(w)) for i, w in docs.items()])).collect()
    got = {r.doc_id for r in rows}
    exact = brute.repeated_words([(i, " ".join(w)) for i, w in docs.items()], passages.WORDS)
    assert got - want <= exact  # nothing else but what an edit leaves whole
    assert len(want & got) >= 0.98 * len(want)
    assert all(r.doc_id // 10 == r.class_doc_id // 10 and r.similarity >= 0.8 for r in rows)


def test_edited_copies_of_a_hot_passage_are_no_square(documents):
    rng = random.Random(12)
    p = words(rng, 90)
    docs = [(i, " ".join(words(rng, 20) + (p if i % 2 else edited(rng, p, 1)) + words(rng, 20))) for i in range(300)]
    got = passages.repeats(documents(docs)).collect()
    assert {r.doc_id for r in got} == set(range(300)) and len(got) < 6000


def test_pairs_are_compared_by_the_words_in_their_ranges(spark):
    """Each text is scanned once and only its ranges meet the other's; equal ids of different texts meet in all ways (op7, CPU seconds)."""
    rng = random.Random(5)
    some = lambda n: [f"W{rng.randrange(10**6)}é" for _ in range(n)]
    shared = some(70)
    edited = [*shared[:30], "other", *shared[31:]]
    rows = [(1, some(300) + shared + some(40)), (2, some(5) + edited + some(500)), (2, shared), (3, some(3)), (4, None)]
    docs = spark.createDataFrame([(i, t and "  ".join(t) + "!") for i, t in rows], "doc_id bigint, text string")
    pairs = [(2, 1, 0, 100, 250, 400), (3, 1, 0, 90, 250, 340), (4, 1, 0, 90, 250, 340), (2, 1, 900, 990, 250, 340)]
    found = passages._compared(docs, spark.createDataFrame(pairs, "doc_id bigint, rep bigint, lo int, hi int, rlo int, rhi int"))
    assert "text" not in found._jdf.queryExecution().optimizedPlan().toString()  # whole texts no longer travel with pairs
    want = set()
    for d, r, lo, hi, rlo, rhi in pairs:
        for a in (t for i, t in rows if i == d and t):
            for b in (t for i, t in rows if i == r):
                (x, _, _), (y, _, _) = (shingles(scan(pa.array([" ".join(t)])), passages.SHINGLE) for t in (a, b))
                want |= {(d, lo + p, q - p + passages.SHINGLE - 1, r, rlo + s, e - s + passages.SHINGLE - 1, j) for p, q, s, e, j in passages.aligned(x[lo:hi], y[rlo:rhi])}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) == 2


def test_repeats_near_a_place_are_found_by_looking_around_it():
    """The same marks as by ordering all shingles of a text (op7, CPU seconds)."""
    rng = np.random.default_rng(3)
    for n, many in ((0, 1), (1, 1), (40, 5), (400, 30), (400, 3000)):
        h = rng.integers(0, many, n).astype(np.uint64)
        want = [any(abs(i - j) < passages.LEAST and i != j and h[i] == h[j] for j in range(n)) for i in range(n)]
        assert passages._twice(h, np.arange(n)).tolist() == want


def test_representatives_are_found_without_the_sides_of_windows(spark):
    """The first pass over the texts makes no sides, which only the second reads (op7, CPU seconds)."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200)))], "doc_id bigint, text string")
    short, whole = passages.windows(docs, sides_too=False), passages.windows(docs)
    assert short.columns == ["key", "k", "doc_id", "at", "lo", "hi"]
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, whole.select(short.columns).collect()))
