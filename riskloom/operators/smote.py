"""SMOTE oversampling (G13) — Chawla et al. 2002.

Neighbours are found among the minority in one of two ways that the caller chooses:

* ``exact``, at any size: about sqrt(n) rows are pivots, a row belongs to its nearest one, and
  rows ordered by (pivot, distance to it) make blocks of ``BLOCK``.  A row's k nearest of its
  own block, or the k nearest pivots, bound how far its neighbours can be; by the triangle
  inequality a block can hold one only if the row's distance to the block's
  pivot is within that bound of the block's range of distances.  A task holds the rows of ``GROUP``
  blocks while all other groups pass by, and measures just the pairs of those blocks: by a matrix
  product, then, where that leaves a pair in doubt, by the sum over the columns.  How many pairs are
  left depends on the data: clusters are told apart, in many dimensions without structure nothing rules pairs out.
* ``projections``: ``PROJECTIONS`` fixed random directions; along each, the
  ``REACH`` rows before and after are candidates, whose true distances decide.  Work is
  linear in the rows, and neighbours far apart along all directions are missed.

Synthesis: ``n_maj − n_min`` draws pick a minority row, one of its k neighbours and a
fraction u, all from hashes of the draw's number, so a draw is the same at any
partitioning; x_new = x + u·(x_nn − x).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .alerts import hash_fraction
from .models import draws, numbered_minority
from .ranking import global_row_number

BLOCK = 256
SLACK = 1e-9  # bounds are widened by this share, against rounding
PROJECTIONS, REACH = 12, 8
GROUP = 16  # blocks whose rows a task holds while all others pass
EPS = float(np.finfo(float).eps)
PROBES = 1 << 20  # pairs that a task measures at a time, but for those of one row
PLACED = 1024  # rows whose distances to the pivots are held at a time
RANGE = 4096  # rows of one range along a direction


def _dist(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _placed(pts: DataFrame, pivots: np.ndarray, numbers: np.ndarray, k: int) -> DataFrame:
    """pick, v, the nearest pivot (``cell``), the distance to it and the distance to the k-th pivot that is another row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[i:i + PLACED].reset_index(drop=True) for b in batches for i in range(0, max(len(b), 1), PLACED)):
            v = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, pivots.shape[1]))
            d = np.stack([np.sqrt(((pivots - x) ** 2).sum(axis=1)) for x in v]) if len(pdf) else np.zeros((0, len(pivots)))
            cell = d.argmin(axis=1) if len(pdf) else np.zeros(0, int)
            others = d.copy()
            own = np.minimum(np.searchsorted(numbers, pdf["pick"].to_numpy()), len(numbers) - 1)
            rows = np.flatnonzero(numbers[own] == pdf["pick"].to_numpy())  # pivots are rows too
            others[rows, own[rows]] = np.inf
            far = np.sort(others, axis=1)[:, k - 1] if len(pivots) >= k else np.full(len(pdf), np.inf)
            yield pd.DataFrame({"pick": pdf["pick"], "v": pdf["v"], "cell": cell, "near": d[np.arange(len(d)), cell], "far": far})

    return pts.select("pick", "v").mapInPandas(run, "pick bigint, v array<double>, cell int, near double, far double")


class _Group:
    """Rows of consecutive blocks with their k nearest so far: (row, dist, j), a null distance as -1, which comes first."""

    def __init__(self, pick: np.ndarray, v: np.ndarray, void: np.ndarray, block: np.ndarray, far: np.ndarray, pivots: np.ndarray, k: int):
        self.pick, self.v, self.void, self.block, self.k = pick, v, void, block, k
        self.columns, self.squares = np.ascontiguousarray(v.T), (v * v).sum(axis=1)
        self.row, self.dist, self.j = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.new: list[tuple] = []
        self.limit = np.full(len(pick), np.inf)  # the square of the k-th distance
        home = np.full(len(pick), np.nan)
        for _, at in _runs(block):
            rows = np.arange(at.start, at.stop)
            for some in (rows[i:i + max(1, PROBES // len(rows))] for i in range(0, len(rows), max(1, PROBES // len(rows)))):
                r, m = (x.ravel() for x in np.meshgrid(some, rows, indexing="ij"))
                r, m = r[r != m], m[r != m]
                d = self._exact(r, self.columns[:, at], void[at], m - at.start)
                self.new.append((r, d, pick[m]))
                full = np.sort(np.where(d < 0, np.nan, d).reshape(len(some), -1), axis=1)  # nulls and NaN at the end
                known = (~(d < 0)).reshape(len(some), -1).sum(axis=1)
                if full.shape[1] >= k:
                    home[some] = np.where(known >= k, full[:, k - 1], np.nan)
        self._merge()
        self.bound = np.fmin(far, home)
        with np.errstate(invalid="ignore"):
            self.to_pivots = np.stack([np.sqrt(((pivots - x) ** 2).sum(axis=1)) for x in v])

    def _exact(self, rows: np.ndarray, columns: np.ndarray, void: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Distances of pairs, summed in the order of the columns."""
        total = np.zeros(len(rows))
        for mine, other in zip(self.columns, columns):
            step = mine[rows] - other[members]
            total += step * step
        return np.where(self.void[rows] | void[members], -1.0, np.sqrt(total))

    def _merge(self) -> None:
        row, dist, j = (np.concatenate(c) for c in zip((self.row, self.dist, self.j), *self.new))
        order = np.lexsort((j, dist, row))
        row, dist, j = row[order], dist[order], j[order]
        start = np.searchsorted(row, row)
        keep = np.arange(len(row)) - start < self.k
        self.row, self.dist, self.j, self.new = row[keep], dist[keep], j[keep], []
        last = (np.arange(len(row)) - start == self.k - 1) & ~np.isnan(dist)
        self.limit[row[last]] = np.maximum(dist[last], 0) ** 2

    def meet(self, other: tuple, cells: tuple[np.ndarray, np.ndarray], ranges: dict[int, tuple[float, float]]) -> None:
        """The rows of a group's blocks, ``other`` = (pick, v, void, block), that can be near rows of this one in other blocks."""
        pick, v, void, block = other
        low, high = cells
        wide = self.bound * (1 + SLACK) + SLACK
        for number, at in _runs(block):
            c, (least, most) = int(number % len(low)), ranges[number]
            d = self.to_pivots[:, c]
            hit = np.flatnonzero((self.block != number) & (d - wide <= most) & (d + wide >= least) & (d - wide <= high[c]) & (d + wide >= low[c]))
            columns, squares = np.ascontiguousarray(v[at].T), (v[at] * v[at]).sum(axis=1)
            step = max(1, PROBES // (at.stop - at.start))
            for rows in (hit[i:i + step] for i in range(0, len(hit), step)):
                sizes = self.squares[rows][:, None] + squares
                near = sizes - 2.0 * (self.v[rows] @ columns)  # but for rounding
                r, m = np.nonzero(~(near > self.limit[rows][:, None] * (1 + SLACK) + (8 + 4 * len(columns)) * EPS * sizes) | void[at])
                if len(r):
                    self.new.append((rows[r], self._exact(rows[r], columns, void[at], m), pick[at][m]))
                if sum(len(x[0]) for x in self.new) >= PROBES:
                    self._merge()
        if self.new:
            self._merge()

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.pick[self.row]), pa.array(self.j), pa.array(self.dist, pa.float64(), mask=self.dist < 0)], ["i", "j", "dist"])


def _runs(block: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
        yield int(block[lo]), slice(lo, hi)


def _packed(rows: DataFrame) -> DataFrame:
    """(g, pick, v, void, block, far): the rows of a group in the order of their blocks, as bytes; void are those with null values."""
    def row(g: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        flat = pc.list_flatten(t["v"]).combine_chunks()
        void = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(t), -1).any(axis=1)
        far = t["far"].to_numpy()  # NaN if null
        data = t["pick"].to_numpy().astype(np.int64), flat.to_numpy(zero_copy_only=False).astype(float), void, t["block"].to_numpy().astype(np.int64), far.astype(float)
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in data]], ["g", "pick", "v", "void", "block", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for b in batches:
            if b.num_rows:
                for g, at in _runs(b.column(0).to_numpy()):
                    if g != last and parts:
                        yield row(last, parts)
                        parts = []
                    last = g
                    parts.append(b.slice(at.start, at.stop - at.start))
        if parts:
            yield row(last, parts)

    dealt = rows.withColumn("g", F.floor((F.col("no") - 1) / (BLOCK * GROUP)).cast("long")).repartition("g").sortWithinPartitions("g", "no")
    return dealt.select("g", "pick", "v", "block", "far").mapInArrow(run, "g bigint, pick binary, v binary, void binary, block binary, far binary")


def neighbour_pairs(pts: DataFrame, n: int, k: int) -> DataFrame:
    """(i, j, dist) of the k nearest of each i among all rows: exact, by pivots."""
    ensure_checkpoint_dir(pts.sparkSession)
    pts = pts.select("pick", "v").checkpoint(eager=True)
    if n < 2:
        return pts.select(F.col("pick").alias("i"), F.col("pick").alias("j"), F.lit(0.0).alias("dist")).limit(0)
    first = pts.orderBy("pick").limit(max(k + 1, math.isqrt(n))).collect()  # sqrt(n) rows; picks are drawn by hash
    pivots, numbers = np.array([r.v for r in first], dtype=float), np.array([r.pick for r in first])
    numbered = global_row_number(_placed(pts, pivots, numbers, k), [F.col("cell"), F.col("near"), F.col("pick")], "no")
    # a block is of one cell; its number rises with the order
    rows = numbered.withColumn("block", F.floor((F.col("no") - 1) / BLOCK) * len(pivots) + F.col("cell")).checkpoint(eager=True)
    # n / BLOCK + sqrt(n) rows of four numbers
    blocks = rows.groupBy("cell", "block").agg(F.min("near").alias("low"), F.max("near").alias("high")).toPandas().sort_values(["cell", "block"])
    at = np.searchsorted(blocks["cell"].to_numpy(), np.arange(len(pivots) + 1))
    low, high = blocks["low"].to_numpy(dtype=float), blocks["high"].to_numpy(dtype=float)
    cells = (np.array([low[a:b].min() if b > a else np.inf for a, b in zip(at, at[1:])]), np.array([high[a:b].max() if b > a else -np.inf for a, b in zip(at, at[1:])]))
    ranges = dict(zip(blocks["block"].tolist(), zip(low.tolist(), high.tolist())))
    groups = _packed(rows).checkpoint(eager=True)
    # a group's task holds its rows; all other groups pass it one at a time
    parts = ["pick", "v", "void", "block", "far"]
    others = groups.crossJoin(F.broadcast(groups.select(F.col("g").alias("to")))).where("g <> to")
    dealt = groups.select(F.col("g").alias("to"), F.lit(0).alias("kind"), *parts).unionByName(others.select("to", F.lit(1).alias("kind"), *parts))
    dealt = dealt.repartition(-(-n // (BLOCK * GROUP)), "to").sortWithinPartitions("to", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for b in batches:
            for kind, *data in zip(b.column(1).to_pylist(), *b.columns[2:]):
                pick, v, void, block, far = (np.frombuffer(x.as_py(), t) for x, t in zip(data, (np.int64, float, bool, np.int64, float)))
                v = v.reshape(len(pick), -1)
                if not kind:
                    if group is not None:
                        yield group.found()
                    group = _Group(pick, v, void, block, far, pivots, k)
                group.meet((pick, v, void, block), cells, ranges)
        if group is not None:
            yield group.found()

    return dealt.mapInArrow(run, "i bigint, j bigint, dist double")


def _by_projections(pts: DataFrame, n: int, width: int) -> DataFrame:
    """(i, j, dist) of pairs that are near each other along one of the directions."""
    other = pts.select(F.col("pick").alias("j"), F.col("v").alias("vj"))
    mine = pts.select(F.col("pick").alias("i"), F.col("v").alias("vi"))
    axes = np.random.default_rng(7).standard_normal((PROJECTIONS, width))
    parts = []
    for a in axes:
        p = reduce(lambda x, y: x + y, [F.col("v")[d] * F.lit(float(w)) for d, w in enumerate(a)])
        # ranges of RANGE rows along the direction
        placed = global_row_number(pts.select(F.col("pick").alias("i"), p.alias("p")), [F.col("p"), F.col("i")], "no")
        w = Window.partitionBy(F.floor((F.col("no") - 1) / RANGE)).orderBy("no")
        near = F.array_compact(F.array(*[f("i", k).over(w) for k in range(1, REACH + 1) for f in (F.lag, F.lead)]))
        # outer form: an inner explode would have the window pushed into a filter
        parts.append(placed.select("i", near.alias("near")).select("i", F.explode_outer("near").alias("j")).where("j is not null"))
    pairs = reduce(DataFrame.unionByName, parts).distinct()
    return pairs.join(mine, "i").join(other, "j").select("i", "j", _dist(F.col("vi"), F.col("vj")).alias("dist"))


def knn_minority(pts: DataFrame, n: int, width: int, k: int, method: str = "exact") -> DataFrame:
    """(i, rank, j, dist): k nearest among ``pts`` (pick, v), ties by number."""
    d = neighbour_pairs(pts, n, k) if method == "exact" else _by_projections(pts, n, width)
    best = Window.partitionBy("i").orderBy("dist", "j")
    return d.select("i", "j", "dist", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= k)


def synthetic(df: DataFrame, features: list[str], label: str, key: str, k_neighbors: int = 3, seed: int = 42, method: str = "exact") -> DataFrame:
    """(draw, ``key``, neighbour, u, x): each synthetic row's origin and values; ``x`` in order of ``features``."""
    minority, _, n_min, n_maj = numbered_minority(df, label, key, seed)
    k = min(k_neighbors, n_min - 1)
    pts = minority.select("pick", F.col(key).alias("key"), F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("v"))
    nn = knn_minority(pts, n_min, len(features), max(k, 1), method)
    number = F.col("draw").cast("string")
    picked = draws(df.sparkSession, max(n_maj - n_min, 0) if k > 0 else 0, max(n_min, 1), seed).select(
        "draw", F.col("pick").alias("i"), (F.floor(hash_fraction(F.concat(number, F.lit(f"|{seed + 1}"))) * F.lit(k)) + 1).cast("int").alias("rank"),
        hash_fraction(F.concat(number, F.lit(f"|{seed + 2}"))).alias("u"))
    mine = pts.select(F.col("pick").alias("i"), F.col("key").alias(key), "v")
    other = pts.select(F.col("pick").alias("j"), F.col("key").alias("neighbour"), F.col("v").alias("vj"))
    return picked.join(nn, ["i", "rank"]).join(mine, "i").join(other, "j").select(
        "draw", key, "neighbour", "u", F.transform(F.arrays_zip("v", "vj", F.array_repeat("u", len(features)).alias("u")),
                                                   lambda e: e["v"] + e["u"] * (e["vj"] - e["v"])).alias("x"))


def smote(df: DataFrame, features: list[str], label: str, key: str, k_neighbors: int = 3, seed: int = 42, method: str = "exact") -> DataFrame:
    """Minority synthesised to the majority size (original rows kept; no key on new ones)."""
    _, mino, n_min, n_maj = numbered_minority(df, label, key, seed)
    if n_min < 2 or n_maj == n_min:
        return df.select(*features, label)
    x = synthetic(df, features, label, key, k_neighbors, seed, method)
    return df.select(*features, label).unionByName(x.select(*[F.col("x")[i].alias(f) for i, f in enumerate(features)], F.lit(mino).cast(df.schema[label].dataType).alias(label)))
