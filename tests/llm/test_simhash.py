import random
import re

import numpy as np
import xxhash

from riskloom.llm import queries, simhash

from ..conftest import SF_SMALL


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def component_of(values):
    """The least place of each value's component, by all pairs."""
    v = np.array(values, np.uint64)
    label = np.arange(len(v))
    near = np.stack([np.bitwise_count(v ^ x) <= 3 for x in v]) if len(v) else np.zeros((0, 0), bool)
    while True:
        new = np.array([label[row].min() for row in near], dtype=label.dtype) if len(v) else label
        if (new == label).all():
            return label
        label = new


def brute(rows):
    values = [fingerprint(t) for _, t in rows]
    label = component_of(values)
    out = []
    for (i, _), v, c in zip(rows, values, label):
        ids = [j for (j, _), d in zip(rows, label) if d == c and j is not None]
        out.append((i, f"{v:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def scattered(rng, n, centres, most=7):
    out = set()
    heart = [rng.getrandbits(64) for _ in range(centres)]
    while len(out) < n:
        x = rng.choice(heart)
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def test_trees_find_all_pairs():
    rng = random.Random(1)
    for n, centres in ((1, 1), (2, 1), (300, 1), (500, 9), (700, 700)):
        values = np.array(scattered(rng, n, centres), np.uint64)
        shard = np.sort(np.array([rng.randrange(3) for _ in range(n)]))
        got = sorted((int(a), int(b)) for x, y in simhash.Forest(values, shard).links(3) for a, b in zip(x, y))
        want = [(a, b) for a in range(n) for b in range(a + 1, n) if shard[a] == shard[b] and int(values[a] ^ values[b]).bit_count() <= 3]
        assert got == sorted(want)


def test_dense_groups_are_dealt_again(spark):
    rng = random.Random(2)
    values = scattered(rng, 1500, 3, 6) + scattered(rng, 300, 300)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    edges = simhash.links(df, shard=256).collect()
    assert edges
    place = {v: i for i, v in enumerate(signed)}
    label = np.arange(len(signed))
    for _ in range(60):
        for r in edges:
            a, b = place[r.a], place[r.b]
            label[a] = label[b] = min(label[a], label[b])
    assert (label == component_of(values)).all()


def test_edits_ties_nulls_and_long_texts(spark, documents):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [" ".join(rng.choices(words, k=300)) for _ in range(6)]
    for i in range(150):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((1000 - i, " ".join(t)))
    rows += [(5, None), (6, ""), (7, " \t\n\x0b\x0c\r"), (None, "alone here"), (None, base[0]), (8, "ONE"), (9, "one"), (10, "one two"), (10, "one two"), (11, "a b İ É"),
             (12, "long " * 50_000), (13, "\x1c\x85 x"), (14, base[1].replace(" ", " \n"))]
    got = queries_of(spark, documents(rows))
    assert got == brute(rows)


def queries_of(spark, df):
    from pyspark.sql import functions as F
    got = simhash.classes(df.withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x")))
    return sorted(((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in got.collect()), key=str)


def test_no_rows(spark, documents):
    assert queries_of(spark, documents([])) == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_simhash(spark, SF_SMALL).collect()), key=str) == brute(rows)
