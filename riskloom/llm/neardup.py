"""Operator 10: near-duplicate classes by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles: term frequency times
``sqrt(1 + ln(N / df) / ln(N))``.  The damped idf keeps the weights of rare and common
shingles within a factor of 1.42: in a large group of copies, whose shingles are common,
an edit must not count for much more than what it replaced.  ``df`` counts documents over
the whole corpus in a table of ``SLOTS`` hashed counters, whose size does not depend on
the corpus.  ``BANDS * ROWS`` consistent weighted samples give ``BANDS`` band keys; texts that share one are candidates; a link is
a candidate pair whose weighted Jaccard similarity, computed on the whole sets, is
``THRESHOLD`` or more; classes are the connected components of the links.

Candidates of a bucket are not paired with each other.  Every text of a bucket is verified
against its pivot, the text that shares most band keys with others (of near copies of one
original, that nearest to it).  That leaves pairs of different components in one bucket.
What a text has that no other component of those buckets has can't be shared with theirs;
the rest, added up in ``GROUPS`` hashed groups of shingles, bounds from above what two
texts share.  Only pairs within that bound are verified, found by joining on narrow
ranges of weight.  No pair is skipped for its
bucket's size.

Equal texts are one node from the start.  Null, empty and wordless texts are not near
anything: each such distinct text is a class with its own copies (null counts as empty).
Repeated rows fall into one class.  A class is named by its smallest doc_id; one without
ids by a negative number.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise, text_key
from riskloom.llm.components import components
from riskloom.llm.wordscan import mix, pieces, scan, shingles

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
SLOTS, SLOT_BLOCK = 1 << 20, 1 << 12
DRAWS = 16  # log2 of the table of random draws
SEED = 20
GROUPS = 32

_SLOT_SHIFT = np.uint64(64 - 20)


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of r ~ Gamma(2,1), ln c with c ~ Gamma(2,1), and beta ~ U(0,1); odd multipliers.

    A shingle's draws for a sample are the entry that its hash times the sample's
    multiplier selects.
    """
    rng = np.random.default_rng(SEED)
    n = 1 << DRAWS
    r = rng.gamma(2.0, 1.0, n).astype(np.float32)
    log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
    beta = rng.random(n).astype(np.float32)
    return r, log_c, beta, rng.integers(1, 1 << 62, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def weighted_sets(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, first index of each text's set; one more entry than texts)."""
    h, owner, _ = shingles(scan(texts), SHINGLE)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    h, owner = h[at], owner[at]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    return h, (tf * idf[(h >> _SLOT_SHIFT).astype(np.int64)]).astype(np.float32), first


def signatures(h: np.ndarray, weight: np.ndarray, first: np.ndarray, draws: tuple) -> np.ndarray:
    """Band keys, sets x BANDS, of non-empty sets that follow each other."""
    r_of, log_c_of, beta_of, odd = draws
    sets = len(first) - 1
    log_w = np.log(weight)
    size = np.diff(first)
    out = np.empty((sets, BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(sets, band + 1, dtype=np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            i = ((h * odd[k]) >> np.uint64(64 - DRAWS)).astype(np.int32)
            r, beta = r_of[i], beta_of[i]
            t = np.floor(log_w / r + beta)
            log_a = log_c_of[i] - r * (t - beta + 1)
            least = np.minimum.reduceat(log_a, first[:-1])
            hit = np.flatnonzero(log_a == np.repeat(least, size))
            hit = hit[np.searchsorted(hit, first[:-1])]  # the first of equal ones
            key = mix(key ^ mix(h[hit] + t[hit].astype(np.int64).view(np.uint64)))
        out[:, band] = key
    return out


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(idf of each slot, rows counted); SLOTS counters come to the driver, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, dtype=np.int64), 0
        one = np.ones(SLOTS)
        for b in batches:
            n += b.num_rows
            for _, texts in pieces(b.column(0)):
                h, _, _ = weighted_sets(texts, one)
                total += np.bincount((h >> _SLOT_SHIFT).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["slot", "c"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for block, slot, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                counts = np.zeros(SLOT_BLOCK, dtype=np.int64)
                counts[slot.values.to_numpy() - block * SLOT_BLOCK] = c.values.to_numpy()
                out.append(counts.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["block", "counts"])

    counted = docs.select("text").mapInArrow(run, "slot int, c bigint").groupBy("slot").agg(F.sum("c").alias("c"))
    counted = materialise(counted, "neardup_df")
    n = counted.where("slot = -1").agg(F.sum("c")).first()[0] or 0
    blocks = (counted.where("slot >= 0").groupBy(F.floor(F.col("slot") / SLOT_BLOCK).cast("int").alias("block"))
              .agg(F.collect_list("slot").alias("slot"), F.collect_list("c").alias("c")).mapInArrow(pack, "block int, counts binary"))
    df = np.ones(SLOTS)
    for block, counts in blocks.collect():
        df[block * SLOT_BLOCK:(block + 1) * SLOT_BLOCK] = np.maximum(np.frombuffer(counts, np.int64), 1)
    scale = np.log(max(n, 2))
    return np.sqrt(1 + np.maximum(np.log(max(n, 2)) - np.log(df), 0) / scale).astype(np.float32), n


def _sign(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, h1, h2, bands (null for a wordless text)."""
    shared = docs.sparkSession.sparkContext.broadcast((idf, _draws()))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, draws = shared.value
        for b in batches:
            for at, texts in pieces(b.column(3), 1 << 19):
                h, weight, first = weighted_sets(texts, idf)
                full = np.flatnonzero(np.diff(first) > 0)
                bands: list = [None] * len(texts)
                if len(full):
                    keys = signatures(h, weight, np.append(first[full], len(h)), draws).view(np.int64).tolist()
                    for i, k in zip(full.tolist(), keys, strict=True):
                        bands[i] = k
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(texts)).columns[:3], pa.array(bands, pa.list_(pa.int64()))],
                                                 ["doc_id", "h1", "h2", "bands"])

    return docs.select("doc_id", *text_key(), "text").mapInArrow(run, f"doc_id {id_type}, h1 bigint, h2 bigint, bands array<bigint>")


def _similarity(pairs: DataFrame, idf: np.ndarray) -> DataFrame:
    """a, b, d of rows (a, b, text_a, text_b): 1 - weighted Jaccard similarity of the texts."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                b = batch.slice(lo, 64)
                n, d = b.num_rows, []
                ha, wa, fa = weighted_sets(b.column(2), idf)
                hb, wb, fb = weighted_sets(b.column(3), idf)
                for i in range(n):
                    x, y = slice(fa[i], fa[i + 1]), slice(fb[i], fb[i + 1])
                    _, p, q = np.intersect1d(ha[x], hb[y], assume_unique=True, return_indices=True)
                    both = np.minimum(wa[x][p], wb[y][q]).sum(dtype=np.float64)
                    d.append(1 - both / (wa[x].sum(dtype=np.float64) + wb[y].sum(dtype=np.float64) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64())], ["a", "b", "d"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, d double")


def _verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, step: str) -> DataFrame:
    """Distance of each pair (a, b) of node numbers; ``texts`` has (node, text)."""
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return materialise(_similarity(pairs.join(tb, "b").join(ta, "a"), idf), step)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, h1, h2 (its text's key), class_id, n_texts, node.

    ``class_id`` is shared by exactly the documents of a class; ``n_texts`` counts the
    class's distinct texts, ``node`` numbers them; ``kept`` marks the class's first text,
    the one with the smallest doc_id.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    idf, _ = document_frequency(docs)
    rows = materialise(_sign(docs, idf), "neardup_rows")
    nodes = materialise(
        rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "neardup_nodes")
    member = nodes.where("bands is not null").select("node", F.posexplode("bands").alias("band", "key"))
    sizes = member.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(member.join(sizes, ["band", "key"]), "neardup_shared")
    central = shared.groupBy("node").agg(F.sum("n").alias("c"))
    order = F.struct((-F.col("c")).alias("c"), "node")
    pivots = shared.join(central, "node").groupBy("band", "key").agg(F.min(order)["node"].alias("pivot"))
    shared = materialise(shared.select("band", "key", "node", "n").join(pivots, ["band", "key"]), "neardup_members")
    star = shared.where("node != pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    needed = shared.select("node").distinct().join(nodes.select("node", "h1", "h2"), "node")
    keyed = docs.select(*text_key(), "text")
    texts = materialise(keyed.join(needed, ["h1", "h2"]).groupBy("node").agg(F.first("text").alias("text")), "neardup_texts")
    tested = _verify(star, texts, idf, "neardup_star")
    near = F.col("d") <= 1 - THRESHOLD + 1e-9
    links = tested.where(near)
    label = components(links.select("a", "b"))
    pairs = _left_over(shared, label, nodes, texts, idf).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = _verify(pairs, texts, idf, "neardup_more")
    label = components(links.unionByName(more.where(near)).select("a", "b"))

    named = nodes.join(label, "node", "left").withColumn("comp", F.coalesce("label", "node"))
    named = materialise(named.select("h1", "h2", "node", "first_id", "comp"), "neardup_named")
    best = F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "node"))
    group = named.groupBy("comp").agg(best.alias("best"), F.count("*").alias("n_texts"))
    group = group.select("comp", F.coalesce(F.col("best.first_id").cast("long"), -1 - F.col("comp")).alias("class_id"),
                         F.col("best.node").alias("kept_node"), "n_texts")
    named = materialise(named.join(group, "comp").select("h1", "h2", "node", "first_id", "class_id", "n_texts", (F.col("node") == F.col("kept_node")).alias("kept")),
                        "neardup_classes")
    return rows.select("doc_id", "h1", "h2").join(named, ["h1", "h2"])


def _weighed(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """node, comp, shingle, weight of rows (node, comp, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in pieces(b.column(2)):
                h, weight, first = weighted_sets(texts, shared.value)
                own = pa.array(np.repeat(np.arange(len(texts)), np.diff(first)))
                part = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(h.view(np.int64)), pa.array(weight.astype(np.float64))],
                                                 ["node", "comp", "shingle", "weight"])

    return rows.select("node", "comp", "text").mapInArrow(run, "node bigint, comp bigint, shingle bigint, weight double")


def _left_over(shared: DataFrame, label: DataFrame, nodes: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """Pairs (a, b) of one bucket and of different components that may still be similar.

    Of a text of weight w, let s be the weight of shingles that other components have too.
    With a text of another component and weight v it shares at most s, so similarity t
    needs s >= t / (1 + t) * (w + v), which is v <= s (1 + t) / t - w, and
    v >= t w; and the same the other way round.  Nor can two texts share more than the
    lesser of their s in any group of shingles, summed over the groups.  A pair is made in
    the first band that both share, so once.
    """
    named = shared.join(label, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    by_bucket = named.groupBy("band", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("band", "key")
    # a bucket of two has been verified in full
    mixed = materialise(named.where("n > 2").join(by_bucket, ["band", "key"]).select("band", "key", "node", "comp"), "neardup_mixed")
    members = mixed.select("node", "comp").distinct()
    weighed = materialise(_weighed(members.join(texts, "node"), idf), "neardup_weighed")
    only = weighed.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x = y").select("shingle")
    t, slack = THRESHOLD, 1e-6
    group = F.pmod(F.shiftright("shingle", 7), F.lit(GROUPS))
    parts = [F.coalesce(F.sum(F.when(group == i, F.col("weight"))), F.lit(0.0)).cast("float") for i in range(GROUPS)]
    common = weighed.join(only, "shingle", "left_anti").groupBy("node").agg(F.sum("weight").alias("s"), F.array(*parts).alias("parts"))
    w = weighed.groupBy("node").agg(F.sum("weight").alias("w")).join(common, "node")
    w = w.select("node", "w", "parts", (F.col("w") * t * (1 - slack)).alias("lo"), ((F.col("s") * (1 + t) / t - F.col("w")) * (1 + slack)).alias("hi"))
    w = materialise(w.where("hi >= lo"), "neardup_bounds")
    # In each bucket one component, the largest, need not be probed from: the others meet it.
    largest = (mixed.groupBy("band", "key", "comp").agg(F.count("*").alias("c")).groupBy("band", "key")
               .agg(F.max(F.struct("c", "comp"))["comp"].alias("largest")))
    keys = nodes.select("node", F.col("bands").alias("keys"))
    bounded = mixed.join(w, "node").join(keys, "node").withColumn("cell", _cell(F.col("w")))
    probes = bounded.join(largest, ["band", "key"]).where("comp != largest").select(
        "band", "key", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("w").alias("wx"), F.col("lo").alias("lx"), F.col("hi").alias("hx"),
        F.col("keys").alias("kx"), F.col("parts").alias("px"), F.explode(F.sequence(_cell(F.col("lo")), _cell(F.col("hi")))).alias("cell"))
    fits = (F.col("comp") != F.col("cx")) & F.col("w").between(F.col("lx"), F.col("hx")) & F.col("wx").between(F.col("lo"), F.col("hi"))
    first = F.array_position(F.zip_with("kx", "keys", lambda p, q: p == q), True) == F.col("band") + 1
    most = F.aggregate(F.zip_with("px", "parts", lambda p, q: F.least(p, q)), F.lit(0.0), lambda total, x: total + x)
    enough = most * (1 + 1e-5) >= t / (1 + t) * (F.col("wx") + F.col("w"))
    other = bounded.select(F.col("band").alias("b2"), F.col("key").alias("k2"), F.col("cell").alias("c2"), "node", "comp", "w", "lo", "hi", "keys", "parts")
    met = probes.join(other, (F.col("band") == F.col("b2")) & (F.col("key") == F.col("k2")) & (F.col("cell") == F.col("c2")) & fits & first & enough)
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _cell(weight: Column) -> Column:
    """Ranges of weight five per cent wide."""
    return F.floor(F.log(weight) / 0.05)


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, all columns kept: the smallest doc_id's, one of its copies."""
    kept = (classes(docs).where("kept").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
            .select(F.col("doc_id").alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct())
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(text_key(), ("__k1", "__k2"), strict=True)])
    cond = (F.col("__k1") == F.col("__h1")) & (F.col("__k2") == F.col("__h2")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return keyed.join(kept, cond, "left_semi").dropDuplicates(["doc_id", "__k1", "__k2"]).drop("__k1", "__k2")
