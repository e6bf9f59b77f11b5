"""Operator 7: passages that repeat across documents, by compact windows.

A document is its sequence of five-word shingles.  For each of ``HASHES`` hash functions
the Cartesian tree over its values gives the compact windows: a place and the widest
stretch in which its value is least.  All stretches inside a window that contain the place
share its min-hash, so windows of ``LEAST`` shingles or more (about two for every ``LEAST``
shingles) stand for all passages of at least ``WORDS`` words.

Windows of different documents with one min-hash are joined to the smallest document that
has it, never to each other.  Where ``ENOUGH`` hash functions propose overlapping stretches
of the same two documents, the whole stretch is verified: passages are runs of shared
shingles, edits in between allowed as long as the Jaccard similarity of both passages'
shingle sets is ``THRESHOLD`` or more.

A representative may hold only a fragment of what later documents share.  So where a min-hash
of the first hash function has a window that is not inside a verified passage, all exact
stretches of ``LEAST`` shingles of its windows are keys of a second round: documents with
one such stretch have ``WORDS`` equal words (by 64-bit hashes, as in the first round), whoever comes first, so no exact repeat is lost.

Edited passages without ``WORDS`` equal words in a row get a third round.  Each place of a
shared min-hash is keyed again, once for each pair of ``REACHES``, with the least hashes
of the shingles before and after it; keys that span fewer than ``SPAN`` shingles are left
out, so lines and short fragments make none.  Places inside verified passages are taken
only where the same min-hash also has others, one drawn place a class.  The documents of
such a key meet one of them that is drawn by a hash of key and document: with ``f`` fragments in a key, a pair is missed there with probability
``f / (f + 2)`` at most, and a passage has dozens of keys, each drawn anew.

Null texts count as empty; texts below ``WORDS`` words and rows with null ids have no
passages.  Rows that share an id are one document: passages that it repeats itself are not
reported.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise
from riskloom.llm.wordscan import mix, pieces, scan, shingles

SHINGLE, WORDS = 5, 50
LEAST = WORDS - SHINGLE + 1
HALF = LEAST // 2  # of LEAST shingles, so many stand on one side of any of them
ODD = np.uint64(0x9E3779B97F4A7C15)
HASHES, ENOUGH = 4, 2
THRESHOLD = 0.8
# Shingles before and after a place among which the third round takes the least hashes.
REACHES = ((6, 38), (38, 6), (8, 26), (26, 8), (8, 34), (34, 8), (12, 22), (22, 12), (14, 26), (26, 14),
           (17, 17), (20, 20), (24, 24), (28, 28), (32, 32), (44, 44))
SPAN = 24
AROUND = 2 * LEAST  # shingles on each side of a place that are verified for it


def compact_windows(values: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, place, hi) of the windows of ``least`` places or more of each run of ``values``.

    All Cartesian trees are built level by level.  Equal values are ordered by a
    scrambled place, which keeps the trees of repetitive texts flat.
    """
    n = len(values)
    bits = max(1, int(n).bit_length())
    odd = np.uint64(0x9E3779B97F4A7C15 | 1)
    inverse = np.uint64(pow(int(odd), -1, 1 << 64))
    low = np.uint64((1 << bits) - 1)
    ranked = np.empty(n + 1, dtype=np.uint64)
    ranked[:n] = (values & ~low) | ((np.arange(n, dtype=np.uint64) * odd) & low)
    ranked[n] = np.uint64(0xFFFFFFFFFFFFFFFF)
    lo, hi = first[:-1], first[1:]
    keep = hi - lo >= least
    lo, hi = lo[keep], hi[keep]
    out = []
    while len(lo):
        top = np.minimum.reduceat(ranked, np.stack([lo, hi], axis=1).ravel())[::2]
        place = (((top & low) * inverse) & low).astype(np.int64)
        out.append((lo, place, hi))
        lo, hi = np.stack([lo, place + 1], axis=1).ravel(), np.stack([place, hi], axis=1).ravel()
        keep = hi - lo >= least
        lo, hi = lo[keep], hi[keep]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _side(h: np.ndarray, at: np.ndarray, begin: np.ndarray, has: np.ndarray, salt: int) -> pa.Array:
    value, begin = h[at] + np.uint64(salt), np.where(has, begin, 0)
    for j in range(HALF):
        value = value * ODD + h[np.minimum(begin + j, len(h) - 1)]
    return pa.array(mix(value).view(np.int64), mask=~has)


def _twice(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the shingle at each place stands at another less than LEAST places away too."""
    out, here = np.zeros(len(at), bool), h[at]
    for j in range(1, LEAST):
        out |= (h[np.minimum(at + j, len(h) - 1)] == here) & (at + j < len(h))
        out |= (h[np.maximum(at - j, 0)] == here) & (at >= j)
    return out


def windows(docs: DataFrame, sides_too: bool = True) -> DataFrame:
    """key (hash function and min-hash), k, doc_id, at, lo, hi (shingles, hi exclusive), and, if asked for, of the
    first hash function before, after: hashes of the HALF shingles on each side inside the window,
    again: the key where its shingle stands near twice, so that equal stretches may differ in their place."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["key", "k", "doc_id", "at", "lo", "hi"] + ["before", "after", "again"] * sides_too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in pieces(b.column(1)):
                h, owner, _ = shingles(scan(texts), SHINGLE)
                first = np.searchsorted(owner, np.arange(len(texts) + 1))
                ids = b.column(0).slice(start, len(texts))
                for k in range(HASHES):
                    salt = np.uint64((k + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
                    lo, at, hi = compact_windows(mix(h ^ salt), first, LEAST)
                    own = owner[at]
                    base = first[own]
                    sides = [pa.nulls(len(at), pa.int64())] * 3 if sides_too else []
                    if sides and k == 0:
                        sides = [_side(h, at, at - HALF, at - lo >= HALF, 1), _side(h, at, at + 1, hi - at > HALF, 2),
                                 pa.array(mix(h[at] + np.uint64(3)).view(np.int64), mask=~_twice(h, at))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mix(h[at] + salt).view(np.int64)), pa.array(np.full(len(at), k, np.int32)), ids.take(pa.array(own)),
                         pa.array((at - base).astype(np.int32)), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)), *sides],
                        names)

    columns = f"key bigint, k int, doc_id {id_type}, at int, lo int, hi int" + ", before bigint, after bigint, again bigint" * sides_too
    return docs.select("doc_id", "text").mapInArrow(run, columns)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def aligned(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(lo, hi, other lo, other hi, similarity) of the passages that two shingle runs share.

    The stretch from the first to the last shared shingle is taken if it is similar
    enough; else it is cut at its longest break, and the parts are tried.
    """
    if len(a) < LEAST or len(b) < LEAST:
        return []
    if len(a) == len(b) and (a == b).all():
        return [(0, len(a), 0, len(b), 1.0)]
    order = b.argsort(kind="stable")
    ranked = b[order]
    at = np.minimum(ranked.searchsorted(a), len(b) - 1)
    shared = ranked[at] == a
    partner = order[at]
    framed = np.zeros(len(a) + 2, bool)
    framed[1:-1] = shared
    edge = (framed[1:] != framed[:-1]).nonzero()[0]
    heads, tails = edge[::2], edge[1::2]
    upto = np.zeros(len(a) + 1, np.int64)
    shared.cumsum(out=upto[1:])
    least = 2 * THRESHOLD / (1 + THRESHOLD)  # of equal sets' shingles that are shared then
    out, todo = [], [(0, len(heads))] if len(heads) else []
    while todo:
        i, j = todo.pop()
        lo, hi = int(heads[i]), int(tails[j - 1])
        if hi - lo < LEAST:
            continue
        if upto[hi] - upto[lo] >= 0.9 * least * (hi - lo):
            here = shared[lo:hi].nonzero()[0]
            there = partner[lo:hi][here]
            off = there - here
            sorted_off = np.sort(off)
            median = (int(sorted_off[(len(off) - 1) // 2]) + int(sorted_off[len(off) // 2])) / 2
            there = there[np.abs(off - median) <= hi - lo]
            # without any near their median, the partners of a repetitive text lie all over
            x, y = (int(there.min()), int(there.max()) + 1) if len(there) else (0, 0)
            if y - x >= LEAST:
                one, other = _distinct(a[lo:hi]), _distinct(b[x:y])
                all_of = np.sort(np.concatenate([one, other]))
                both = int(np.count_nonzero(all_of[1:] == all_of[:-1]))
                similarity = both / (len(one) + len(other) - both)
                if similarity >= THRESHOLD:
                    out.append((lo, hi, x, y, similarity))
                    continue
        if j - i > 1:
            cut = i + 1 + int(np.argmax(heads[i + 1:j] - tails[i:j - 1]))
            todo += [(i, cut), (cut, j)]
    return out


def _ranges(lists: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ranges listed for each text, cut to the text (a text of the same id may be longer)."""
    own = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    return tuple(np.minimum(first[own] + flat.field(c).to_numpy(zero_copy_only=False), first[own + 1]) for c in (0, 1))


def stretches(docs: DataFrame) -> DataFrame:
    """what (hash of LEAST shingles), doc_id, at, seen (inside a passage of ``cover``), for
    the stretches inside the ranges ``todo`` of each text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in pieces(b.column(1)):
                h, owner, _ = shingles(scan(texts), SHINGLE)
                first = np.searchsorted(owner, np.arange(len(texts) + 1))
                (lo, hi), (past_lo, past_hi) = (_ranges(b.column(c).slice(start, len(texts)), first) for c in (2, 3))
                edge = np.zeros(len(h) + 1, np.int64)
                some = hi - lo >= LEAST
                np.add.at(edge, lo[some], 1)
                np.add.at(edge, hi[some] - LEAST + 1, -1)
                begin = np.flatnonzero(np.cumsum(edge) > 0)
                far = np.zeros(len(h) + 1, np.int64)  # end of the farthest passage that starts here or before
                np.maximum.at(far, past_lo, past_hi)
                seen = np.maximum.accumulate(far)[begin] >= begin + LEAST
                own, value = owner[begin], np.zeros(len(begin), np.uint64)
                for k in range(LEAST):
                    value = value * ODD + h[begin + k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(value).view(np.int64)), b.column(0).slice(start, len(texts)).take(pa.array(own)), pa.array((begin - first[own]).astype(np.int32)), pa.array(seen)],
                    ["what", "doc_id", "at", "seen"])

    return docs.select("doc_id", "text", "todo", "cover").mapInArrow(run, f"what bigint, doc_id {id_type}, at int, seen boolean")


def _least(scrambled: np.ndarray, begin: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
    """Place of the least value in each begin:end of at most ``reach`` places; begin where there are none."""
    at = np.minimum(begin[:, None] + np.arange(reach), np.maximum(end - 1, begin)[:, None])
    return at[np.arange(len(at)), np.argmin(scrambled[at], axis=1)]


def surroundings(docs: DataFrame) -> DataFrame:
    """what (hash of a place's key and its surroundings), doc_id, at, cls for the places ``spots``
    (key, at, cls: the class of the passage that holds it, or null) of each text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in pieces(b.column(1)):
                h, owner, _ = shingles(scan(texts), SHINGLE)
                first = np.searchsorted(owner, np.arange(len(texts) + 1))
                lists = b.column(2).slice(start, len(texts))
                own = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                flat, ids = lists.flatten(), b.column(0).slice(start, len(texts))
                at = first[own] + flat.field(1).to_numpy(zero_copy_only=False)
                inside = np.flatnonzero(at < first[own + 1])  # a text of the same id may be longer
                key = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for j, (left, right) in enumerate(REACHES):
                    salt = np.uint64((j + 11) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
                    scrambled = mix(h ^ salt)
                    for part in range(0, len(inside), 4096):
                        i = inside[part:part + 4096]
                        here, low, high = at[i], first[own[i]], first[own[i] + 1]
                        before = _least(scrambled, np.maximum(here - left, low), here, left)
                        after = _least(scrambled, np.minimum(here + 1, high - 1), np.minimum(here + 1 + right, high), right)
                        far = np.flatnonzero(after - before >= SPAN)
                        i = i[far]
                        what = mix(mix(mix(key[i] + salt) * ODD + h[before[far]]) * ODD + h[after[far]])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(what.view(np.int64)), ids.take(pa.array(own[i])), pa.array((at[i] - first[own[i]]).astype(np.int32)), flat.field(2).take(pa.array(i))],
                            ["what", "doc_id", "at", "cls"])

    return docs.select("doc_id", "text", "spots").mapInArrow(run, f"what bigint, doc_id {id_type}, at int, cls {id_type}")


def cuts(docs: DataFrame) -> DataFrame:
    """doc_id, lo, hi, part: the words of the shingles lo:hi of each text, for its ranges ``todo``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in pieces(b.column(1)):
                w = scan(texts)
                lists = b.column(2).slice(start, len(texts))
                own = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                begin, end = w.first[own] + lo, np.minimum(w.first[own] + hi + SHINGLE - 1, w.first[own + 1])
                some = np.flatnonzero(end - begin >= WORDS)  # no passage is shorter
                for at in range(0, len(some), 4096):
                    i = some[at:at + 4096]
                    bounds = zip(w.start[begin[i]].tolist(), w.end[end[i] - 1].tolist(), strict=True)
                    parts = pa.array([w.data[x:y].tobytes() for x, y in bounds], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(start, len(texts)).take(pa.array(own[i])), pa.array(lo[i].astype(np.int32)), pa.array(hi[i].astype(np.int32)), parts],
                        ["doc_id", "lo", "hi", "part"])

    return docs.select("doc_id", "text", "todo").mapInArrow(run, f"doc_id {id_type}, lo int, hi int, part binary")


def _verified(pairs: DataFrame) -> DataFrame:
    id_type = pairs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "n_words", "class_doc_id", "class_start", "class_words", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                b = batch.slice(part, 256)
                (ha, oa, _), (hb, ob, _) = (shingles(scan(b.column(i).cast(pa.large_binary()).view(pa.large_string())), SHINGLE) for i in (4, 5))
                fa, fb = (np.searchsorted(o, np.arange(b.num_rows + 1)) for o in (oa, ob))
                lo, rlo = (b.column(i).to_numpy() for i in (2, 3))
                rows, found = [], []
                for i in range(b.num_rows):
                    for p, q, r, s, j in aligned(ha[fa[i]:fa[i + 1]], hb[fb[i]:fb[i + 1]]):
                        rows.append(i)
                        found.append((int(lo[i]) + p, q - p + SHINGLE - 1, int(rlo[i]) + r, s - r + SHINGLE - 1, j))
                at, cols = pa.array(rows, pa.int64()), list(zip(*found, strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), b.column(1).take(at),
                     pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64())], names)

    return pairs.select("doc_id", "rep", "lo", "rlo", "part", "rep_part").mapInArrow(
        run, f"doc_id {id_type}, start bigint, n_words bigint, class_doc_id {id_type}, class_start bigint, class_words bigint, similarity double")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_words (words), class_doc_id, class_start, class_words, similarity.

    A row for each passage of a document that the class document has too, and one
    (similarity 1) for the class document's own.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    found = windows(docs)
    one = F.struct("doc_id", "at", "lo", "hi")
    reps = (windows(docs, sides_too=False).groupBy("key").agg(F.min(one).alias("r"), F.max("doc_id").alias("last")).where("r.doc_id != last")
            .select("key", F.col("r.doc_id").alias("rep"), F.col("r.at").alias("rat"), F.col("r.lo").alias("rlo"), F.col("r.hi").alias("rhi")))
    reps = materialise(reps, "passage_reps")
    hits = found.join(reps, "key").where("doc_id != rep or k = 0")
    # What both windows can share lies on one diagonal around the shared place.
    left, right = F.least(F.col("at") - F.col("lo"), F.col("rat") - F.col("rlo")), F.least(F.col("hi") - F.col("at"), F.col("rhi") - F.col("rat"))
    slack = F.ceil((left + right) * 0.25).cast("int")  # for insertions and deletions inside
    hits = materialise(hits.select("key", "at", "doc_id", "rep", "k", F.greatest(F.col("at") - left - slack, F.lit(0)).alias("lo"), (F.col("at") + right + slack).alias("hi"),
                                   F.greatest(F.col("rat") - left - slack, F.lit(0)).alias("rlo"), (F.col("rat") + right + slack).alias("rhi"),
                                   "before", "after", "again",
                                   F.when(F.col("k") == 0, F.greatest("lo", F.col("at") - LEAST + 1)).alias("wlo"),
                                   F.when(F.col("k") == 0, F.least("hi", F.col("at") + LEAST)).alias("whi")), "passage_hits")
    held = hits.where("k = 0").select("doc_id", "wlo", "whi", "before", "after", "again")
    places = hits.where("doc_id != rep").select("key", "doc_id", "at").union(reps.select("key", "rep", "rat"))
    hits = hits.where("doc_id != rep").drop("key", "at", "before", "after", "again", "wlo", "whi")
    pair = Window.partitionBy("doc_id", "rep").orderBy("lo", "hi", "k")
    past = F.max("hi").over(pair.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("new", F.when(past.isNull() | (F.col("lo") >= past), 1).otherwise(0)).withColumn("run", F.sum("new").over(pair))
    pairs = (runs.groupBy("doc_id", "rep", "run")
             .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("rlo").alias("rlo"), F.max("rhi").alias("rhi"), F.countDistinct("k").alias("n"))
             .where(F.col("n") >= ENOUGH).drop("n", "run"))
    pairs = materialise(pairs, "passage_pairs")
    rows = materialise(_compared(docs, pairs).distinct(), "passage_rows")
    second = materialise(_second_round(docs, held, rows), "passage_second")
    third = materialise(_third_round(docs, places, rows), "passage_third")
    rows = rows.unionByName(second).unionByName(third).distinct()
    return rows.unionByName(_own(rows))


def _compared(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The passages of ``pairs`` (doc_id, rep and ranges of both), by the words in these ranges, cut out of each text once."""
    used = pairs.select("doc_id", "lo", "hi").union(pairs.select("rep", "rlo", "rhi")).distinct()
    todo = used.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("todo"))
    parts = materialise(cuts(docs.join(todo, "doc_id")).distinct(), "passage_parts")
    return _verified(pairs.join(parts, ["doc_id", "lo", "hi"]).join(parts.toDF("rep", "rlo", "rhi", "rep_part"), ["rep", "rlo", "rhi"]))


def _own(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("class_doc_id").alias("doc_id"), F.col("class_start").alias("start"), F.col("class_words").alias("n_words"),
                       "class_doc_id", "class_start", "class_words", F.lit(1.0).alias("similarity")).distinct()


def _second_round(docs: DataFrame, held: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of equal stretches that no row of ``rows`` holds, from windows ``held`` (doc_id, wlo, whi and sides)."""
    # Windows with an equal stretch around their place agree on one of its sides, or it is not the same place.
    sides = held.select("doc_id", F.col("wlo").alias("lo"), F.col("whi").alias("hi"), F.explode(F.array("before", "after", "again")).alias("side")).where("side is not null")
    shared = materialise(sides.groupBy("side").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep != last").select("side"), "passage_sides")
    sides = materialise(sides.join(shared, "side"), "passage_sided")
    cover = rows.unionByName(_own(rows)).select("doc_id", F.col("start").cast("int").alias("lo"), (F.col("start") + F.col("n_words") - (SHINGLE - 1)).cast("int").alias("hi")).distinct()
    # A window is inside a passage if the farthest end of those that start before it is past its own.
    both = (sides.select("doc_id", "lo", "hi", "side", F.lit(0).alias("end"), F.lit(1).alias("turn"))
            .union(cover.select("doc_id", "lo", "hi", F.lit(None).cast("bigint"), F.col("hi"), F.lit(0))))
    far = F.max("end").over(Window.partitionBy("doc_id").orderBy("lo", "turn").rowsBetween(Window.unboundedPreceding, 0))
    unseen = materialise(both.withColumn("far", far).where((F.col("turn") == 1) & (F.col("far") < F.col("hi"))).select("side").distinct(), "passage_unseen")
    todo = sides.join(unseen, "side").groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("todo"))
    ranges = materialise(todo.join(cover.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("cover")), "doc_id", "left"), "passage_ranges")
    found = materialise(stretches(docs.join(ranges, "doc_id")).distinct(), "passage_stretches")
    shared = found.groupBy("what").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.min("seen").alias("all_seen"))
    shared = materialise(shared.where("rep != last and not all_seen").select("what", "rep"), "passage_stretch_keys")
    found = materialise(found.join(shared, "what"), "passage_stretch_hits")
    reps = found.where("doc_id = rep").groupBy("what").agg(F.min("at").alias("rat"), F.min("seen").alias("rseen"))
    hits = (found.join(materialise(reps, "passage_stretch_reps"), "what").where("doc_id != rep")
            .groupBy("doc_id", "rep", "at", "rat").agg(F.min(F.col("seen") & F.col("rseen")).alias("seen")).withColumn("off", F.col("rat") - F.col("at")))
    line = Window.partitionBy("doc_id", "rep", "off").orderBy("at")
    gap = F.col("at") - F.lag("at").over(line)
    runs = hits.withColumn("new", F.when(gap.isNull() | (gap > 1), 1).otherwise(0)).withColumn("run", F.sum("new").over(line))
    pairs = runs.groupBy("doc_id", "rep", "off", "run").agg(F.min("at").alias("lo"), F.max("at").alias("last"), F.min("seen").alias("seen")).where("not seen")
    long = F.col("last").cast("long") - F.col("lo") + WORDS
    return pairs.select("doc_id", F.col("lo").cast("long").alias("start"), long.alias("n_words"), F.col("rep").alias("class_doc_id"),
                        (F.col("lo") + F.col("off")).cast("long").alias("class_start"), long.alias("class_words"), F.lit(1.0).alias("similarity"))


def _third_round(docs: DataFrame, places: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of passages around ``places`` (key, doc_id, at), at least one of the two outside the passages of ``rows``."""
    cover = rows.unionByName(_own(rows)).select(
        "doc_id", F.col("start").cast("int").alias("at"), F.struct((F.col("start") + F.col("n_words") - (SHINGLE - 1)).cast("int").alias("hi"), F.col("class_doc_id").alias("cls")).alias("held"))
    both = places.select("doc_id", "at", "key", F.lit(None).cast(cover.schema["held"].dataType).alias("held"), F.lit(1).alias("turn")).union(
        cover.select("doc_id", "at", F.lit(None).cast("bigint"), "held", F.lit(0)))
    far = F.max("held").over(Window.partitionBy("doc_id").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    spots = materialise(both.withColumn("far", far).where("turn = 1").select("doc_id", "key", "at", F.when(F.col("far.hi") > F.col("at"), F.col("far.cls")).alias("cls")), "passage_spots")

    def open_keys(found: DataFrame, key: str, *more: Column) -> DataFrame:
        """Keys of several documents, not all of which have the place in a passage."""
        return (found.groupBy(key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), (F.count("cls") < F.count("*")).alias("some"), *more)
                .where("least != last and some").drop("least", "last", "some"))

    spots = materialise(spots.join(open_keys(spots, "key"), "key"), "passage_open")
    # Of the places that a class holds, one drawn for each key stands for the class.
    drawn = F.min(F.struct(F.xxhash64("doc_id", "key").alias("draw"), "doc_id", "at")).alias("r")
    classes = spots.where("cls is not null").groupBy("key", "cls").agg(drawn).select("r.doc_id", "key", "r.at", "cls")
    spots = spots.where("cls is null").select("doc_id", "key", "at", "cls").union(classes)
    listed = materialise(spots.groupBy("doc_id").agg(F.collect_set(F.struct("key", "at", "cls")).alias("spots")), "passage_listed")
    found = materialise(surroundings(docs.join(listed, "doc_id")), "passage_surroundings")
    drawn = F.min(F.struct(F.xxhash64("doc_id", "what").alias("draw"), F.col("doc_id").alias("rep"), F.col("at").alias("rat"), F.col("cls").alias("rcls"))).alias("r")
    reps = materialise(open_keys(found, "what", drawn).select("what", "r.rep", "r.rat", "r.rcls"), "passage_drawn")
    met = found.join(reps, "what").where("doc_id != rep and (cls is null or rcls is null)").select(
        F.greatest("doc_id", "rep").alias("doc_id"), F.least("doc_id", "rep").alias("rep"),
        F.when(F.col("doc_id") > F.col("rep"), F.col("at")).otherwise(F.col("rat")).alias("at"), F.when(F.col("doc_id") > F.col("rep"), F.col("rat")).otherwise(F.col("at")).alias("rat")).distinct()
    line = Window.partitionBy("doc_id", "rep").orderBy("at", "rat")
    gap, turn = F.col("at") - F.lag("at").over(line), F.abs(F.col("rat") - F.lag("rat").over(line))
    runs = met.withColumn("new", F.when(gap.isNull() | (gap > AROUND) | (turn > 2 * AROUND), 1).otherwise(0)).withColumn("run", F.sum("new").over(line))
    pairs = runs.groupBy("doc_id", "rep", "run").agg(
        F.greatest(F.min("at") - AROUND, F.lit(0)).alias("lo"), (F.max("at") + AROUND).alias("hi"), F.greatest(F.min("rat") - AROUND, F.lit(0)).alias("rlo"), (F.max("rat") + AROUND).alias("rhi")).drop("run")
    return _compared(docs, materialise(pairs, "passage_met")).distinct()
