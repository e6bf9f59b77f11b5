"""Operator 3: benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one
window).  A window is contained in a document exactly if all its shingles are, in
place; so the one rarest shingle is its necessary prefix.  Shingles are ordered by
their frequency over all documents, every window is indexed under its rarest one,
documents are probed for those shingles only, positions bound where the window could
start and end, and the words around the shingle verify the window exactly.

Between the two passes over the documents only counts and the benchmark's own
shingles move.  A bitmap of fixed size (``BITS``, whatever the benchmark's size)
tells the passes which shingles can matter; its false positives leave in the joins.

Null or wordless texts have no words and no hits; wordless items have no windows.
Repeated rows and null ids are kept: results are found per (id, text) and joined back.
Only the id and text columns of either table are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise, same, text_key
from riskloom.llm.wordscan import Words, pieces, scan, shingles

WINDOW = 10
SHINGLE = 3
BITS = 1 << 23

KEY = ["doc_id", "h1", "h2"]


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)) & np.uint64(BITS - 1)


def _bitmap(grams: DataFrame) -> np.ndarray:
    """BITS bits as bytes; at most BITS / 64 long values come to the driver."""
    slot = F.shiftrightunsigned("gram", 20).bitwiseAND(F.lit(BITS - 1))
    words = (grams.select(slot.alias("s"))
             .groupBy(F.shiftright("s", 6).cast("int").alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(63).cast("int"))).alias("v")))
    out = np.zeros(BITS // 64, dtype=np.int64)
    for w, v in words.collect():
        out[w] = v
    return out.view(np.uint8)


def _known(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    s = _slot(h)
    return (bitmap[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _grams(w: Words, sizes: list[int], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word) of every run of ``sizes`` words that the bitmap knows."""
    parts = []
    for k in sizes:
        h, owner, at = shingles(w, k)
        keep = _known(bitmap, h) & (w.counts[owner] >= k)
        parts.append((h[keep], owner[keep], at[keep]))
    h, owner, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, owner, at


def _windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, win (its words joined by blanks), n (words), grams (one for each offset)."""
    item_type = benchmark.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in pieces(b.column(1)):
                w = scan(texts)
                item, win, size, grams = [], [], [], []
                for i, n in enumerate(w.counts.tolist()):
                    words = [w.text(j) for j in range(w.first[i], w.first[i + 1])]
                    k = min(SHINGLE, n)
                    one = Words(w.data, np.array([0, n]), w.start[w.first[i]:w.first[i + 1]], w.end[w.first[i]:w.first[i + 1]],
                                w.hash[w.first[i]:w.first[i + 1]])
                    h = shingles(one, k)[0].view(np.int64) if n else None
                    for s in range(max(n - WINDOW, 0) + 1 if n else 0):
                        item.append(at + i)
                        win.append(" ".join(words[s:s + WINDOW]))
                        size.append(min(n, WINDOW))
                        grams.append(h[s:s + min(n, WINDOW) - k + 1].tolist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(item, pa.int64())), pa.array(win, pa.string()), pa.array(size, pa.int32()),
                     pa.array(grams, pa.list_(pa.int64()))], ["item", "win", "n", "grams"])

    return benchmark.select(id_col, text_col).mapInArrow(run, f"item {item_type}, win string, n int, grams array<bigint>")


def _count(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """gram, c: occurrences in all documents, summed inside each batch first."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    sizes = list(range(1, SHINGLE + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_grams(scan(texts), sizes, shared.value)[0] for _, texts in pieces(b.column(0))]
            gram, c = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(c.astype(np.int64))], ["gram", "c"])

    return docs.select("text").mapInArrow(run, "gram bigint, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def _probe(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Per document its key, n_words and the prefix shingles in it.

    ``occ`` holds (gram, word index, words before it that follow, the words from
    there to where a window with it could end).
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    sizes, around = list(range(1, SHINGLE + 1)), WINDOW - 1
    id_type = docs.schema["doc_id"].dataType.simpleString()
    occ_type = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("ctx", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in pieces(b.column(3)):
                w = scan(texts)
                h, owner, word = _grams(w, sizes, shared.value)
                order = np.argsort(owner, kind="stable")
                h, owner, word = h[order].view(np.int64), owner[order], word[order]
                lo = np.maximum(word - around, w.first[owner])
                hi = np.minimum(word + WINDOW, w.first[owner + 1])
                ctx = [" ".join([w.text(j) for j in range(x, y)]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                inner = pa.StructArray.from_arrays(
                    [pa.array(h), pa.array((word - w.first[owner]).astype(np.int32)), pa.array((word - lo).astype(np.int32)),
                     pa.array(ctx, pa.string())], fields=list(occ_type.value_type))
                ends = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                part = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), inner)],
                    [*KEY, "n_words", "occ"])

    return docs.select(*KEY, "text").mapInArrow(
        run, f"doc_id {id_type}, h1 bigint, h2 bigint, n_words bigint, occ array<struct<gram:bigint,at:int,lead:int,ctx:string>>")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, items).

    documents: key and n_words of each row; hits: each occurrence of a window as
    (key, start word, n words, win); items: the items of each window (win, item).
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = materialise(_windows(benchmark, item_col, item_text), "bench_windows")
    wins = items.groupBy("win", "n").agg(F.first("grams").alias("grams"))
    grams = wins.select("win", "n", F.posexplode("grams").alias("offset", "gram"))
    counts = _count(docs, _bitmap(items.select(F.explode("grams").alias("gram"))))
    # A window with a shingle that no document has can't occur: the rarest has c = 0.
    prefix = materialise(
        grams.join(counts, "gram", "left")
        .groupBy("win", "n").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram", "offset")).alias("p"))
        .where("p.c > 0").select("win", "n", "p.gram", "p.offset"), "bench_prefix")
    probed = materialise(_probe(docs.select("doc_id", *text_key(), "text"), _bitmap(prefix)), "bench_probe")
    occ = probed.where(F.size("occ") > 0).select(*KEY, "n_words", F.explode("occ").alias("o")).select(*KEY, "n_words", "o.*")
    start = F.col("at") - F.col("offset")
    found = (occ.join(prefix, "gram")
             .where((start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("offset") <= F.col("lead")))
             .where(F.array_join(F.slice(F.split("ctx", " "), F.col("lead") - F.col("offset") + 1, F.col("n")), " ") == F.col("win"))
             .select(*KEY, start.cast("long").alias("start"), F.col("n").cast("long").alias("n"), "win")
             .distinct())
    return probed.select(*KEY, "n_words"), found, items.select("win", "item").distinct()


def contaminate(docs: DataFrame, benchmark: DataFrame, **cols: str) -> DataFrame:
    """One row per document row: key, n_words, n_hit, items (sorted as strings), contaminated.

    ``n_hit`` counts the words inside any occurrence, ``items`` are those with an
    occurring window.
    """
    base, found, items = hits(docs, benchmark, **cols)
    found = materialise(found, "bench_hits")
    before = Window.partitionBy(*KEY).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    covered = (found.select(*KEY, "start", "n").distinct()
               .withColumn("seen", F.coalesce(F.max(end).over(before), F.lit(0)))
               .groupBy(*KEY).agg(F.sum(F.greatest(end - F.greatest("start", "seen"), F.lit(0))).alias("n_hit")))
    named = (found.select(*KEY, "win").distinct().join(items, "win")
             .groupBy(*KEY).agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")))
    got = covered.join(named, same(covered, named, KEY), "left").select(covered["*"], "items")
    return (base.join(got, same(base, got, KEY), "left")
            .select(*[base[c] for c in KEY], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns kept."""
    _, found, _ = hits(docs, benchmark)
    bad = found.select(*KEY).distinct()
    keyed = docs.select("*", *[c.alias(f"__{n}") for c, n in zip(text_key(), ("h1", "h2"), strict=True)])
    cond = keyed["doc_id"].eqNullSafe(bad["doc_id"]) & (keyed["__h1"] == bad["h1"]) & (keyed["__h2"] == bad["h2"])
    return keyed.join(bad, cond, "left_anti").drop("__h1", "__h2")
