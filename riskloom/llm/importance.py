"""Resampling of documents towards a target distribution, by importance weights.

Features are runs of one to three words, hashed into ``BUCKETS`` counters.  The weight of
a document is the sum over its features of the log ratio of the target's to the
documents' smoothed bucket frequencies; a hash of its id adds Gumbel noise, so that the
highest scores are a sample without replacement in proportion to the weights.

Scores are ranked by a distributed radix sort from the least digit up.  The key is
(score descending, id ascending), cut into digits of ``DIGIT`` bits.  Each pass is a stable
counting sort: rows lie in blocks of ``BLOCK`` consecutive places; blocks count their
digits; prefix sums over (digit, block) give where the rows of a block with a digit go;
a row's place among them, in their old order, gives its new place.  Blocks are of equal
size whatever the keys, so a frequent digit is no large task.

Defined results: null texts have no words, weight 0 and 0 features; a null id counts as
empty in the hash and comes before all others among ties; rows of the same id and score
are ranked as read; columns but doc_id and text are ignored; an empty corpus gives no
rows, an empty target weights that only count the corpus.  Ids are longs that span less
than 2^63.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise
from riskloom.llm.wordscan import Words, pieces, scan

BUCKETS = 10_000
RUN = 3          # words of the longest feature
LEAST_WORDS = 20
SHARE = (5, 100)
SEED = 42
DIGIT = 12       # bits
BLOCK = 1 << 14  # places; their windows and counts are all that one task holds
PIECE = 1 << 18  # bytes of text whose features a task holds at a time, if one text has no more

_POLY = 0xEDB88320


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1).astype(np.uint32)
    return t


class Crc:
    """crc32 of joined byte strings from their parts' crc32, for many strings at once.

    crc(a + b) is crc(a) pushed through as many zero bytes as b has, xor crc(b).  Pushing is linear, so
    it is four table reads a length; tables are made for powers of two and applied bit by
    bit of the length, so lengths have no limit.
    """

    def __init__(self) -> None:
        self.byte = _byte_table()
        self.push = [self._tables(self._zero_byte)]

    def _zero_byte(self, c: np.ndarray) -> np.ndarray:
        return self.byte[c & 255] ^ (c >> 8)

    @staticmethod
    def _tables(step) -> np.ndarray:
        lanes = np.arange(256, dtype=np.uint32)
        return np.stack([step(lanes << np.uint32(8 * k)) for k in range(4)])

    @staticmethod
    def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]

    def zeros(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``c`` pushed through ``n`` zero bytes."""
        c, k = c.copy(), 0
        while len(n) and (n >> k).any():
            if k == len(self.push):
                last = self.push[-1]
                self.push.append(self._tables(lambda x, t=last: self._apply(t, self._apply(t, x))))
            at = np.flatnonzero((n >> k) & 1)
            c[at] = self._apply(self.push[k], c[at])
            k += 1
        return c

    def words(self, w: Words) -> np.ndarray:
        """crc32 of each word."""
        size = w.end - w.start
        c = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
        left, j = np.arange(len(size)), 0
        while len(left):
            left = left[size[left] > j]
            c[left] = self.byte[(c[left] ^ w.data[w.start[left] + j]) & 255] ^ (c[left] >> 8)
            j += 1
        return ~c


def features(w: Words, crc: Crc) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each run of one to ``RUN`` words, repeats included."""
    one, size, owner = crc.words(w), (w.end - w.start).astype(np.int64), w.owner()
    space = np.uint32(zlib.crc32(b" "))
    buckets, owners, run = [one % BUCKETS], [owner], one
    for k in range(1, RUN):
        n = max(len(one) - k, 0)
        joined = crc.zeros(run[:n], np.ones(n, np.int64)) ^ space
        run = crc.zeros(joined, size[k:k + n]) ^ one[k:k + n]
        inside = owner[:n] == owner[k:k + n]
        buckets.append(run[inside] % BUCKETS)
        owners.append(owner[:n][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def histogram(texts: DataFrame) -> np.ndarray:
    """Features of all texts in each of the ``BUCKETS`` (a vector of fixed size)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, total = Crc(), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, some in pieces(b.column(0), PIECE):
                total += np.bincount(features(scan(some), crc)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to corpus frequency by bucket."""
    s_all, t_all = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variable drawn by the hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = Crc()
        for b in batches:
            for at, some in pieces(b.column(1), PIECE):
                w = scan(some)
                bucket, owner = features(w, crc)
                n = len(some)
                order = np.argsort(owner, kind="stable")
                sums = np.concatenate([[0], np.cumsum(shared.value[bucket[order]])])
                count = np.bincount(owner, minlength=n)
                last = np.cumsum(count)
                weight = sums[last] - sums[last - count]
                ids = b.column(0).slice(at, n)
                score = [x + noise(i) for x, i in zip(weight.tolist(), ids.to_pylist())]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in (w.counts, count, weight, score)]],
                                                 ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def digits(low: int, high: int, digit: int = DIGIT) -> list[int]:
    """Shifts of the digits that values from ``low`` to ``high`` can differ in."""
    return list(range(0, (high - low).bit_length(), digit))


def radix_ranks(rows: DataFrame, keys: list[tuple[str, bool]], digit: int = DIGIT, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``place``, from 0, in the order of ``keys`` (long column, whether descending; nulls first if not).

    One stable counting sort for each digit of each key, from the last key's least digit up.
    """
    spans = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c, _ in keys for f in (F.min, F.max)]).first()
    passes = []
    for c, descending in reversed(keys):
        low, high = spans[f"min_{c}"], spans[f"max_{c}"]
        if low is not None:
            # 0 is for nulls; the difference to the end that comes first is never negative
            value = F.coalesce((F.lit(high) - F.col(c) if descending else F.col(c) - F.lit(low)) + F.lit(1), F.lit(0))
            passes += [F.shiftright(value, s).bitwiseAND((1 << digit) - 1) for s in digits(low, high + 1, digit)]
    at = materialise(rows.withColumn("place", F.monotonically_increasing_id()), "radix")
    if not passes:
        passes = [F.lit(0)]
    for value in passes:
        cut = at.withColumn("block", F.floor(F.col("place") / block)).withColumn("digit", value)
        counts = cut.groupBy("digit", "block").agg(F.count("*").alias("n"))
        before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        counts = materialise(counts.withColumn("among", F.coalesce(F.sum("n").over(before), F.lit(0))), "radix_counts")
        # one row a digit: at most 2^digit
        totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))
        ordered = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select("digit", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("start"))
        to = counts.join(F.broadcast(starts), "digit").select("digit", "block", (F.col("start") + F.col("among")).alias("to"))
        own = Window.partitionBy("block", "digit").orderBy("place")
        moved = (cut.withColumn("own", F.row_number().over(own) - 1).join(to, ["block", "digit"])
                 .withColumn("place", F.col("to") + F.col("own")).select(*rows.columns, "place"))
        at = materialise(moved, "radix")
    return at


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and, if it is drawn, its rank from 1."""
    rows = scored(docs, gains(histogram(docs), histogram(target)))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "importance")
    in_draw = rows.where(F.col("n_words") >= least_words)
    drawn = in_draw.count() * share[0] // share[1]
    ranked = radix_ranks(in_draw.select("row", "doc_id", "score"), [("score", True), ("doc_id", False)])
    ranks = ranked.where(F.col("place") < drawn).select("row", (F.col("place") + 1).alias("rank"))
    return rows.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
