"""Operator 6: exact top-k inner products by no-random-access aggregation.

Vectors are dealt into blocks of about ``BLOCK`` rows, stated queries into blocks of about
``QUERIES``; every query block meets every vector block, one pair at a time.  Inside a block
each dimension is a list sorted by value.  For a query the lists are read from the end its
sign prefers, in steps down to ``DEPTHS`` of their length; a row's seen terms plus the
worst, or the next unread, values of the other lists are its lower and upper bound.  The
queries of a block read in step, so a step is a few matrix products.  A query stops when no
row outside at most ``LEFT`` candidates, seen or not, can reach its k-th best lower bound;
those candidates' scores are then resolved.  The blocks' results meet in one more
aggregation by k.  All numbers are integers and sums stay in the range where the floating
point type is exact (components up to 2**20, say), so results are exact.

Components are scaled to ``floor(SCALE * x)``.  Vectors that are null, empty or of another
length than most, or that hold null or non-finite components, take no part; nor do rows
with null ids.  Rows that repeat an id are candidates each; a query whose id repeats is
asked once, with its smallest vector.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise

SCALE = 256
BLOCK, QUERIES = 8192, 256
KINDS = (np.int16, np.int32, np.int64)
DEPTHS = (1 / 4, 1 / 2, 3 / 4, 7 / 8)
LEFT = 64


class SortedBlock:
    """Rows of one block with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.sorted = np.sort(self.rows, axis=0)
        self.rank = np.argsort(np.argsort(self.rows, axis=0, kind="stable"), axis=0, kind="stable").astype(np.int32)
        self.largest = int(np.abs(self.rows).max(initial=0))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of the k best rows of each query, without its own id's."""
        n, dims = self.rows.shape
        bound = dims * self.largest * int(np.abs(queries).max(initial=0))
        kind = np.float32 if 2 * bound < 1 << 24 else np.float64
        x, low, high = self.rows.astype(kind), self.sorted[0].astype(kind), self.sorted[-1].astype(kind)
        own = np.searchsorted(self.ids, query_ids), np.searchsorted(self.ids, query_ids, side="right")
        todo, out, at = np.arange(len(queries)), [], 0
        up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)  # lists read from the top, from the bottom
        seen = np.zeros((len(queries), n), kind)
        missing = np.repeat((up @ low + down @ high)[:, None], n, axis=1)  # the least that unread lists add
        for depth in DEPTHS if n > 4 * (k + LEFT) else ():
            to = int(n * depth)
            tops, bottoms = self.rank >= n - to, self.rank < to
            new_top, new_bottom = tops & (self.rank < n - at), bottoms & (self.rank >= at)
            seen += up @ np.where(new_top, x, 0).T + down @ np.where(new_bottom, x, 0).T
            missing -= (up * low) @ new_top.T.astype(kind) + (down * high) @ new_bottom.T.astype(kind)
            lower = seen + missing
            next_up, next_down = up * self.sorted[n - 1 - to].astype(kind), down * self.sorted[to].astype(kind)
            upper = seen + (next_up.sum(axis=1) + next_down.sum(axis=1))[:, None]
            upper -= next_up @ tops.T.astype(kind) + next_down @ bottoms.T.astype(kind)
            for i, q in enumerate(todo):
                lower[i, own[0][q]:own[1][q]] = upper[i, own[0][q]:own[1][q]] = -np.inf
            bar = np.partition(lower, n - k, axis=1)[:, n - k]
            may = upper >= bar[:, None]
            done = may.sum(axis=1) <= LEFT + k
            for i in np.flatnonzero(done):
                out.append(self._resolved(todo[i], np.flatnonzero(may[i]), queries, k))
            go = ~done
            todo, up, down, seen, missing, at = todo[go], up[go], down[go], seen[go], missing[go], to
            if not len(todo):
                break
        for q in todo:  # read to the end
            out.append(self._resolved(q, np.r_[0:own[0][q], own[1][q]:n], queries, k))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def _resolved(self, q: int, rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = self.rows[rows] @ queries[q]
        if len(rows) > 4 * k:
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            rows, scores = rows[some], scores[some]
        top = np.lexsort((self.ids[rows], -scores))[:k]
        return np.full(len(top), q), self.ids[rows[top]], scores[top]


def scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("bigint"))


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(sound)
            .select(F.col(id_col).cast("long").alias("vec_id"), scaled(v).alias("v")))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(block, ids, flat): the rows (vec_id, v) of each partition in numbered blocks of at most ``size``, values in as few bytes as they need."""
    def block(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, flat = (np.concatenate(c) for c in zip(*parts, strict=True))
        kind = next(t for t in KINDS if len(flat) == 0 or np.iinfo(t).min <= flat.min() and flat.max() <= np.iinfo(t).max)
        return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([flat.astype(kind).tobytes()], pa.binary())], ["ids", "flat"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                some = b.slice(at, min(size - held, b.num_rows - at))
                parts.append((some.column(0).to_numpy().astype(np.int64), some.column(1).flatten().to_numpy().astype(np.int64)))
                at, held = at + some.num_rows, held + some.num_rows
                if held == size:
                    yield block(parts)
                    parts, held = [], 0
        if held:
            yield block(parts)

    return rows.select("vec_id", "v").mapInArrow(run, "ids binary, flat binary").withColumn("block", F.monotonically_increasing_id())


def _unpacked(ids: pa.Scalar, flat: pa.Scalar, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids, flat = np.frombuffer(ids.as_py(), np.int64), flat.as_py()
    kind = next(t for t in KINDS if np.dtype(t).itemsize * len(ids) * width == len(flat))
    return ids, np.frombuffer(flat, kind).astype(np.int64).reshape(-1, width)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query (a condition on ``id_col``) its k best rows."""
    rows = _usable(vectors, id_col, vector_col)
    counted = rows.withColumnRenamed("vec_id", id_col).groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.count_if(queries).alias("q"))
    most = counted.agg(F.max(F.struct("n", "w", "q")).alias("x")).first()["x"]
    if most is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    n, w, q = most
    rows = rows.where(F.size("v") == w)
    asked = rows.withColumnRenamed("vec_id", id_col).where(queries).groupBy(F.col(id_col).alias("vec_id")).agg(F.min("v").alias("v"))
    # rows are dealt evenly, so a partition is about a block
    blocks = materialise(_packed(rows.repartition(-(-n // BLOCK)), 2 * BLOCK), "topk_blocks")
    asked = materialise(_packed(asked.repartition(max(1, -(-q // QUERIES))), 2 * QUERIES), "topk_queries")
    # Every task gets blocks, each followed by all queries: a block's rows cross once, queries once a block, and nothing but block numbers is broadcast.
    asked = asked.select("ids", "flat").crossJoin(F.broadcast(blocks.select("block")))
    dealt = blocks.select("block", F.lit(0).alias("kind"), "ids", "flat").unionByName(asked.select("block", F.lit(1).alias("kind"), "ids", "flat"))
    dealt = dealt.repartition(-(-n // BLOCK), "block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            for asks, ids, flat in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                some = _unpacked(ids, flat, w)
                if not asks:
                    block = SortedBlock(*some)
                    continue
                place, found, scores = block.best(*some, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (some[0][place], found, scores)], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
