import random

from riskloom.llm import neardup

from ..conftest import SF_SMALL
from . import brute


def classes(df):
    out = {}
    for r in neardup.classes(df).collect():
        out.setdefault(r.class_id, []).append((r.doc_id, r.kept))
    return out


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def near(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"e{rng.randrange(10 ** 9)}"
    return " ".join(words)


def test_against_brute_force(documents):
    rng = random.Random(3)
    docs = []
    for g in range(40):
        base = prose(rng, rng.choice([6, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 3, 6])):
            docs.append(near(rng, base, rng.randrange(0, 1 + len(base) // 60)))
    docs = list(enumerate(docs))
    got = {frozenset(i for i, _ in v) for v in classes(documents(docs)).values()}
    assert got == brute.near_duplicate_classes(docs)


def test_chains_join_even_where_the_pivot_is_far(documents):
    rng = random.Random(5)
    words = prose(rng, 300)
    chain = [list(words)]
    for _ in range(30):  # each a near copy of the one before only
        words = list(words)
        for at in rng.sample(range(300), 4):
            words[at] = f"c{rng.randrange(10 ** 9)}"
        chain.append(words)
    docs = [(i, " ".join(w)) for i, w in enumerate(chain)]
    assert {frozenset(i for i, _ in v) for v in classes(documents(docs)).values()} == brute.near_duplicate_classes(docs)


def test_a_group_of_copies_around_the_threshold(documents):
    rng = random.Random(11)
    base = prose(rng, 150)
    docs = [(i, near(rng, base, rng.randrange(0, 9))) for i in range(120)] + [(500 + i, near(rng, base[:130], rng.randrange(0, 9))) for i in range(40)]
    got = {frozenset(i for i, _ in v) for v in classes(documents(docs)).values()}
    assert got == {frozenset(docs[x][0] for x in s) for s in brute.near_duplicate_classes(docs)}
    assert len(got) > 5  # some stay apart


def test_hot_groups_and_odd_rows(documents):
    rng = random.Random(7)
    base, other = prose(rng, 200), prose(rng, 200)
    docs = [(i, " ".join(base)) for i in range(500)] + [(1000 + i, near(rng, other, 2)) for i in range(150)]
    docs += [(5000, None), (5001, ""), (5002, "..."), (5003, "one two"), (5004, "One, two!"), (5005, "one two three"), (None, "no id here"), (None, None),
             (5006, "again and again and again"), (5006, "again and again and again")]
    got = classes(documents(docs))
    sets = {frozenset(i for i, _ in v) for v in got.values()}
    assert frozenset(range(500)) in sets and frozenset(range(1000, 1150)) in sets
    assert frozenset({5003, 5004}) in sets and frozenset({5002}) in sets and frozenset({5005}) in sets
    assert frozenset({5000, 5001, None}) in sets
    assert got[0] and all(k == min(i for i, _ in v if i is not None) for k, v in got.items() if any(i is not None for i, _ in v))
    kept = neardup.deduplicated(documents(docs).withColumnRenamed("lang", "node").withColumnRenamed("source", "class_id"))
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(str(min((i for i in s if i is not None), default=None)) for s in sets)


def test_empty_table(documents):
    assert neardup.classes(documents([])).collect() == []
    assert neardup.deduplicated(documents([])).collect() == []


def test_small_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {frozenset(docs[i][0] for i in s) for s in brute.near_duplicate_classes(docs)}
    got = {frozenset(i for i, _ in v) for v in classes(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).values()}
    assert got == want
