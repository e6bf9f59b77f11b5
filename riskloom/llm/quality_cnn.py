"""Operator 8: quality classifier, a byte-level convolutional network in numpy.

A document's bytes are embedded, learned filters of ``WIDTH`` bytes run over all of
them, activations are max-pooled in overlapping chunks (``CHUNK`` blocks of ``BLOCK``
bytes, every second block a new chunk) that cover the whole document, a small dense
network scores each chunk from its pooled activations and the share of it that is text
(few bytes can't show much variety), and the chunk scores (mean, least, most) are combined into one
probability.

The network is fitted on a bounded sample of labelled rows outside the held-out fold
(``PER_CLASS`` rows of each label, ``CHUNKS_PER_DOC`` chunks of each, chosen by hash).
Only text is an input of a score.  Null and empty texts are scored as one chunk of
padding.  Without both labels to learn from, every score is the share of label 1 among
the labelled rows, or 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.sampling import fold, training_rows
from riskloom.llm.wordscan import buffers, pieces

GRID = 4  # bytes between filter positions
WIDTH = 2 * GRID
DIM, FILTERS, HIDDEN = 4, 24, 16
BLOCK, CHUNK = 128, 4
PER_CLASS, CHUNKS_PER_DOC = 1500, 6
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
ROUNDS, BATCH, RATE = 10, 128, 0.006
CUT = 0.3  # of training chunks, shortened so that short texts are learnt too


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    dense: np.ndarray  # FILTERS + 2 x HIDDEN: pooled activations, fill, constant
    out: np.ndarray  # HIDDEN + 1
    combine: np.ndarray  # weights of mean, least, most chunk score, and a constant

    def activations(self, data: np.ndarray) -> np.ndarray:
        """Filter outputs at each grid position; ``data`` is padded to the grid."""
        grid = self.embed[data].reshape(-1, GRID * DIM)
        left, right = self.filters[:GRID * DIM], self.filters[GRID * DIM:]
        a = grid @ left
        a[:-1] += (grid @ right)[1:]
        a += self.bias
        return a

    def dense_input(self, pooled: np.ndarray, fill: np.ndarray) -> np.ndarray:
        """``fill``: bytes of text in each chunk."""
        level = np.log2(np.maximum(fill, 1)) / 4 - 1
        return np.column_stack([np.maximum(pooled, 0), level, np.ones(len(level))]).astype(np.float32)

    def chunk_scores(self, pooled: np.ndarray, fill: np.ndarray) -> np.ndarray:
        return np.tanh(self.dense_input(pooled, fill) @ self.dense) @ self.out[:-1] + self.out[-1]


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and chunks of each text, which has a zero grid cell before and after it."""
    blocks = np.maximum(-(-(sizes + WIDTH) // BLOCK), CHUNK)
    blocks += (blocks - CHUNK) % 2
    return blocks, (blocks - CHUNK) // 2 + 1


def padded(raw: np.ndarray, off: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum(blocks)]) * BLOCK
    data = np.zeros(at[-1], dtype=np.uint8)
    data[np.arange(len(raw)) + np.repeat(at[:-1] + GRID - off[:-1], np.diff(off))] = raw
    return data


def document_features(net: Network, texts: pa.Array) -> np.ndarray:
    """mean, least and most chunk score of each text."""
    raw, off = buffers(texts)
    blocks, chunks = layout(np.diff(off))
    data = padded(raw, off, blocks)
    per = BLOCK // GRID
    tops = np.empty((len(data) // BLOCK, FILTERS), dtype=np.float32)
    step = 1024
    for b in range(0, len(tops), step):  # small enough to stay in cache
        part = data[b * BLOCK:(b + step) * BLOCK + GRID]
        if len(part) % BLOCK == 0:
            part = np.concatenate([part, np.zeros(GRID, np.uint8)])
        a = net.activations(part)[:-1]
        tops[b:b + step] = a.reshape(-1, per, FILTERS).max(axis=1)
    first_block = np.cumsum(blocks) - blocks
    first_chunk = np.cumsum(chunks) - chunks
    at = np.repeat(first_block, chunks) + 2 * (np.arange(chunks.sum()) - np.repeat(first_chunk, chunks))
    pooled = tops[at]
    for j in range(1, CHUNK):
        np.maximum(pooled, tops[at + j], out=pooled)
    fill = np.clip(np.repeat(np.diff(off) + first_block * BLOCK, chunks) - at * BLOCK, 0, CHUNK * BLOCK)
    s = net.chunk_scores(pooled, fill).astype(np.float64)
    return np.stack([np.add.reduceat(s, first_chunk) / chunks, np.minimum.reduceat(s, first_chunk),
                     np.maximum.reduceat(s, first_chunk)], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + ridge * len(x) * np.r_[w[:-1], 0]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= scale * m / (np.sqrt(v) + 1e-7)


def fit(chunks: np.ndarray, owner: np.ndarray, y: np.ndarray, seed: int = 17) -> Network:
    """``chunks``: rows of CHUNK * BLOCK bytes; ``owner``: the document of each; ``y``: its labels."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Network((rng.standard_normal((256, DIM)) * 0.5).astype(f32),
                  (rng.standard_normal((WIDTH * DIM, FILTERS)) / np.sqrt(WIDTH * DIM)).astype(f32), np.zeros(FILTERS, f32),
                  (rng.standard_normal((FILTERS + 2, HIDDEN)) / np.sqrt(FILTERS)).astype(f32),
                  (rng.standard_normal(HIDDEN + 1) * 0.1).astype(f32), np.array([1.0, 0.0, 0.0, 0.0]))
    net.embed[0] = 0
    target = y[owner].astype(f32)
    weight = np.where(target == 1, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3)).astype(f32)
    opt = Adam([net.embed, net.filters, net.bias, net.dense, net.out], RATE)
    size = chunks.shape[1]
    full = np.where(chunks.any(axis=1), size - (chunks[:, ::-1] != 0).argmax(axis=1), 0)
    reach = np.arange(WIDTH)
    for r in range(ROUNDS):
        opt.rate = RATE * (1 - r / ROUNDS)
        order = rng.permutation(len(chunks))
        for b in range(0, len(order), BATCH):
            rows = order[b:b + BATCH]
            data, fill, n = chunks[rows], full[rows], len(rows)
            cut = np.flatnonzero(rng.random(n) < CUT)
            fill[cut] = np.minimum(fill[cut], (8 * (size / 8) ** rng.random(len(cut))).astype(np.int64))
            data[np.arange(size) >= fill[:, None]] = 0
            flat = np.concatenate([data.ravel(), np.zeros(GRID, np.uint8)])
            a = net.activations(flat)[:-1].reshape(n, size // GRID, FILTERS)
            a = a[:, :-1]  # the last position of a chunk would read into the next row
            best = a.argmax(axis=1)
            top = np.take_along_axis(a, best[:, None], axis=1)[:, 0]
            x_dense = net.dense_input(top, fill)
            hidden = np.tanh(x_dense @ net.dense)
            p = sigmoid(hidden @ net.out[:-1] + net.out[-1]).astype(f32)
            d = weight[rows] * (p - target[rows]) / n
            g_out = np.concatenate([hidden.T @ d, [d.sum()]]).astype(f32)
            g_hidden = np.outer(d, net.out[:-1]) * (1 - hidden * hidden)
            g_dense = x_dense.T @ g_hidden + 1e-4 * net.dense
            g_top = (g_hidden @ net.dense[:FILTERS].T) * (top > 0)
            window = data[np.arange(n)[:, None, None], best[..., None] * GRID + reach]  # n x FILTERS x WIDTH
            x = net.embed[window].reshape(n, FILTERS, WIDTH * DIM)
            g_filters = np.einsum("nf,nfk->kf", g_top, x)
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, window.ravel(), (g_top[..., None] * net.filters.T[None]).reshape(-1, DIM))
            g_embed[0] = 0
            opt.step([g_embed, g_filters, g_top.sum(axis=0), g_dense, g_out])
    s = np.concatenate([_row_scores(net, chunks[i:i + 512], full[i:i + 512]) for i in range(0, len(chunks), 512)])
    least, most = np.full(len(y), np.inf), np.full(len(y), -np.inf)
    np.minimum.at(least, owner, s)
    np.maximum.at(most, owner, s)
    mean = np.bincount(owner, s, len(y)) / np.maximum(np.bincount(owner, minlength=len(y)), 1)
    share = y.mean()
    net.combine = logistic(np.stack([mean, least, most], axis=1), y,
                           np.where(y == 1, 0.5 / share, 0.5 / (1 - share)))
    return net


def _row_scores(net: Network, rows: np.ndarray, fill: np.ndarray) -> np.ndarray:
    flat = np.concatenate([rows.ravel(), np.zeros(GRID, np.uint8)])
    a = net.activations(flat)[:-1].reshape(len(rows), -1, FILTERS)[:, :-1]
    return net.chunk_scores(a.max(axis=1), fill).astype(np.float64)


def _chunks(sample: DataFrame) -> DataFrame:
    """y, doc, chunk: at most CHUNKS_PER_DOC chunks of each sampled row, spread by a fixed stride."""
    size = CHUNK * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ys, out = [], [], []
            for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = (t or "").encode()
                n = max(1, -(-len(data) // size))
                for k in sorted({(j * n // CHUNKS_PER_DOC + i) % n for j in range(CHUNKS_PER_DOC)}):
                    out.append(data[k * size:(k + 1) * size])
                    ids.append(i)
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(out, pa.binary())],
                                             ["doc", "y", "chunk"])

    return sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y").mapInArrow(run, "doc bigint, y int, chunk binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network | float:
    """The fitted network, or a constant score if there is only one label to learn from."""
    sample = training_rows(docs, labels, label, FOLDS, HELD_OUT, PER_CLASS)
    got = _chunks(sample).toPandas().sort_values(["doc", "chunk"], ignore_index=True)  # bounded by the parameters above
    if not len(got):
        return 0.5
    if got.y.nunique() < 2:
        return float(got.y.iloc[0])
    ids, owner = np.unique(got.doc.to_numpy(), return_inverse=True)
    y = np.zeros(len(ids))
    y[owner] = got.y.to_numpy()
    chunks = np.zeros((len(got), CHUNK * BLOCK), np.uint8)
    for i, c in enumerate(got.chunk):
        chunks[i, :len(c)] = np.frombuffer(c, np.uint8)
    return fit(chunks, owner, y)


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """All columns of ``docs`` plus ``score``, the probability of label 1.

    Every byte of every text is read; a column named ``score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    at_text = docs.columns.index("text")
    names = [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for at, texts in pieces(b.column(at_text), 1 << 20):
                if isinstance(net, float):
                    p = np.full(len(texts), net)
                else:
                    x = document_features(net, texts)
                    p = sigmoid(x @ net.combine[:-1] + net.combine[-1])
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(texts)).columns, pa.array(p)], names)

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score of THRESHOLD or more)."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
