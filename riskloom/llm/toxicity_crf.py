"""Operator 5: toxicity by a linear-chain conditional random field.

Words are tagged toxic or not.  Labelled tokens come from labelled documents: over the
training sample, a word or a word's beginning that marks toxic documents and is all but
absent from the others labels its tokens in toxic documents as toxic.  The field has
hashed features of each word (whole, beginnings, ending, length) and transition weights
between neighbours of a sentence; it is fitted by maximum likelihood.  Forward-backward
gives each word's marginal; a document's score is a logistic function of its largest
marginal and its expected number of toxic words; runs of words at ``TAG`` or more are the
offending spans.

Fitted on a bounded sample of labelled rows outside the held-out fold (``PER_CLASS`` rows
of each label, ``SAMPLE_BYTES`` of whole lines of each, taken by hash).  Only text is an
input of a score.  A sentence longer than ``REACH`` words is tagged in runs of that
length; every word of every text is tagged.  Null and wordless texts have no spans and
the score that belongs to none.  Without both labels, all scores are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.quality_cnn import logistic, sigmoid
from riskloom.llm.sampling import fold, training_rows
from riskloom.llm.wordscan import Words, mix, pieces, scan, shingles

PER_CLASS, SAMPLE_BYTES = 2000, 8192
FOLDS, HELD_OUT = 4, 2
THRESHOLD, TAG = 0.3, 0.5
TOXIC_SHARE = 0.25  # of documents, that the score assumes
REACH = 64
BITS = 18
PREFIXES = (3, 4, 5, 6)
LEAST_DOCS, PURITY = 4, 0.95  # of a feature that labels tokens
ROUNDS, BATCH, RATE = 6, 4096, 0.2

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 33, 46, 63]] = True  # line feed ! . ?


@dataclass
class Field:
    weight: np.ndarray  # of toxic against not, by feature slot
    trans: np.ndarray  # log weights [from, to]
    combine: np.ndarray  # of largest marginal's log odds, log(1 + expected words), constant


def features(w: Words) -> np.ndarray:
    """words x features: slots of the hashed features of each word."""
    size = (w.end - w.start).astype(np.int64)
    lanes = np.ndarray(shape=(len(w.data) - 7,), dtype="<u8", buffer=w.data, strides=(1,))
    head = lanes[w.start]
    cols = [w.hash]
    for k in PREFIXES:
        cut = head & np.uint64((1 << 8 * k) - 1)
        cols.append(np.where(size > k, mix(cut + np.uint64(k << 56)), w.hash))
    tail = lanes[np.maximum(w.end - 3, 0)] & np.uint64((1 << 24) - 1)
    cols.append(mix(np.where(size > 3, tail, np.uint64(0)) + np.uint64(9 << 56)))
    cols.append(mix(np.minimum(size, 15).astype(np.uint64) + np.uint64(10 << 56)))
    h = np.stack(cols, axis=1)
    salt = (np.arange(h.shape[1], dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (((h ^ salt) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32)


def sentences(w: Words) -> np.ndarray:
    """Index of the first word of each run that is tagged together, in word order."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64)
    breaks = np.cumsum(_BREAK[w.data[:-8]], dtype=np.int32)
    at = breaks[w.start]
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = at[1:] != at[:-1]
    firsts = w.first[:-1]
    new[firsts[firsts < n]] = True
    first = np.flatnonzero(new)
    within = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return np.flatnonzero(within % REACH == 0)


def forward_backward(u: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of toxic: forward (with the word's own), backward, and own, for each word.

    Runs are stepped through side by side, longest first.
    """
    e = np.exp(np.clip(u, -30, 30)).astype(np.float64)
    t = np.exp(trans)
    size = np.diff(np.append(first, len(u)))
    order = np.argsort(-size, kind="stable")
    start, size = first[order], size[order]
    fw, bw = e.copy(), np.ones_like(e)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # runs longer than step
    for s in range(1, longest):
        at = start[:active[s]] + s
        r = fw[at - 1]
        fw[at] = e[at] * (r * t[1, 1] + t[0, 1]) / (r * t[1, 0] + t[0, 0])
    for s in range(longest - 2, -1, -1):
        at = start[:active[s + 1]] + s
        r = e[at + 1] * bw[at + 1]
        bw[at] = (t[1, 1] * r + t[1, 0]) / (t[0, 1] * r + t[0, 0])
    return fw, bw, e


def marginals(u: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    fw, bw, _ = forward_backward(u, first, trans)
    odds = fw * bw
    return odds / (1 + odds)


def emissions(field: Field, slots: np.ndarray) -> np.ndarray:
    u = field.weight[slots[:, 0]].copy()
    for j in range(1, slots.shape[1]):
        u += field.weight[slots[:, j]]
    return u


def token_labels(w: Words, y: np.ndarray) -> np.ndarray:
    """Toxic tokens of toxic documents, by features that mark such documents."""
    slots, owner = features(w)[:, :1 + len(PREFIXES)].astype(np.int64), w.owner()
    size = 1 << BITS
    best = np.zeros(len(owner))
    share = max(y.mean(), 1e-9)
    for j in range(slots.shape[1]):
        seen = np.unique(owner * size + slots[:, j])  # each feature once for a document
        in_doc, slot = seen // size, seen % size
        bad = np.bincount(slot, y[in_doc], size)
        good = np.bincount(slot, 1 - y[in_doc], size)
        purity = np.where(bad >= LEAST_DOCS, (bad / share) / np.maximum(bad / share + good / (1 - share), 1e-9), 0)
        # the documents that a feature marks also have to be more than chance would give
        sure = (bad + good) * -np.log(min(share, 0.999)) > np.log(size)
        np.maximum(best, np.where(sure, purity, 0)[slots[:, j]], out=best)
    return ((best >= PURITY) & (y[owner] == 1)).astype(np.float64)


def apart(texts: list[str]) -> np.ndarray:
    """Indices of texts that are no copies of one before, as far as min-hashes tell.

    The words that copies share would look like marks of their label.
    """
    w = scan(pa.array(texts, pa.large_string()))
    h, owner, _ = shingles(w, 5)
    first, keep = np.searchsorted(owner, np.arange(len(texts) + 1)), w.counts > 0
    full = np.flatnonzero(keep)
    for salt in range(1, 4):
        least = np.minimum.reduceat(mix(h ^ np.uint64(salt << 40)), first[full])
        _, one = np.unique(least, return_index=True)
        only = np.zeros(len(texts), dtype=bool)
        only[full[one]] = True
        keep &= only
    return np.flatnonzero(keep)


def fit(texts: list[str], y: np.ndarray, seed: int = 5) -> Field:
    rng = np.random.default_rng(seed)
    alone = apart(texts)
    if len(np.unique(y[alone])) == 2:
        texts, y = [texts[i] for i in alone], y[alone]
    w = scan(pa.array(texts, pa.large_string()))
    slots, first, tag = features(w), sentences(w), token_labels(w, y)
    size = np.diff(np.append(first, len(tag)))
    field = Field(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), np.zeros(3))
    field.weight[slots[:, -1]] = -0.5
    square, t_square = np.full(1 << BITS, 1e-4, np.float32), np.full((2, 2), 1e-4)
    for _ in range(ROUNDS):
        order = rng.permutation(len(first))
        for b in range(0, len(order), BATCH):
            runs = order[b:b + BATCH]
            n = size[runs]
            words = np.repeat(first[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            heads = np.cumsum(n) - n
            x, z = slots[words], tag[words]
            fw, bw, e = forward_backward(emissions(field, x), heads, field.trans)
            p = fw * bw / (1 + fw * bw)
            d = (p - z).astype(np.float32)
            g = np.zeros_like(field.weight)
            for j in range(x.shape[1]):
                g += np.bincount(x[:, j], d, len(g)).astype(np.float32)
            joint = np.ones(len(words), dtype=bool)
            joint[heads] = False
            cur = np.flatnonzero(joint)
            t = np.exp(field.trans)
            pair = np.stack([t[0, 0] * np.ones(len(cur)), t[0, 1] * (q := e[cur] * bw[cur]), t[1, 0] * fw[cur - 1], t[1, 1] * fw[cur - 1] * q])
            pair /= pair.sum(axis=0)
            true = (2 * z[cur - 1] + z[cur]).astype(np.int64)
            g_t = (pair.sum(axis=1) - np.bincount(true, minlength=4)).reshape(2, 2)
            g += 1e-3 * field.weight
            square += g * g
            t_square += g_t * g_t
            field.weight -= RATE * g / np.sqrt(square)
            field.trans -= 0.5 * RATE * g_t / np.sqrt(t_square)
    x = document_features(field, w)[0]
    share = y.mean()
    field.combine = logistic(x, y, np.where(y == 1, TOXIC_SHARE / share, (1 - TOXIC_SHARE) / (1 - share)), ridge=1e-3)
    return field


def document_features(field: Field, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(largest marginal's log odds, log of 1 + expected toxic words) of each text; marginals."""
    p = marginals(emissions(field, features(w)), sentences(w), field.trans) if len(w.start) else np.zeros(0)
    n = len(w.first) - 1
    x = np.zeros((n, 2))
    x[:, 0] = -12
    full = np.flatnonzero(w.counts > 0)
    if len(full):
        top = np.clip(np.maximum.reduceat(p, w.first[full]), 6.2e-6, 1 - 6.2e-6)
        x[full, 0] = np.log(top / (1 - top))
        x[full, 1] = np.log1p(np.add.reduceat(np.where(p > 0.05, p, 0), w.first[full]))
    return x, p


def toxic_spans(w: Words, p: np.ndarray) -> list[list[dict]]:
    """Per text, runs of neighbouring words at TAG or more: code points start, end, and p."""
    out: list[list[dict]] = [[] for _ in range(len(w.first) - 1)]
    hot = np.flatnonzero(p >= TAG)
    if not len(hot):
        return out
    owner = np.searchsorted(w.first, hot, side="right") - 1
    new = np.r_[True, (np.diff(hot) != 1) | (np.diff(owner) != 0)]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(hot)) - 1
    chars = np.cumsum((w.data & 0xC0) != 0x80)  # code points begun up to here
    text_at = w.text_start
    base = np.where(text_at > 0, chars[np.maximum(text_at - 1, 0)], 0)
    for a, b in zip(head.tolist(), last.tolist(), strict=True):
        i = int(owner[a])
        begin, end = chars[w.start[hot[a]]] - 1 - base[i], chars[w.end[hot[b]] - 1] - base[i]
        out[i].append({"start": int(begin), "end": int(end), "p": float(p[hot[a]:hot[b] + 1].max())})
    return out


def _pieces(line: str, most: int = SAMPLE_BYTES // 4) -> Iterator[str]:
    """``line`` cut at blanks into pieces of at most ``most`` characters; a longer word is cut inside."""
    while len(line) > most:
        cut = line.rfind(" ", 1, most)
        cut = most if cut < 0 else cut
        yield line[:cut]
        line = line[cut:].lstrip(" ")
    yield line


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Field | None:
    sample = training_rows(docs, labels, label, FOLDS, HELD_OUT, PER_CLASS)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                t = t or ""
                if len(t) > SAMPLE_BYTES:  # lines, or pieces of long ones, by hash, as many as the bound takes
                    kept, room = [], SAMPLE_BYTES
                    for line in sorted((x for line in t.split("\n") for x in _pieces(line)), key=lambda x: zlib.crc32(x.encode())):
                        if len(line) <= room:
                            kept.append(line)
                            room -= len(line)
                    t = "\n".join(kept)
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(2)], ["doc_id", "text", "y"])

    rows = sample.mapInArrow(lines, sample.schema).toPandas()  # bounded by the parameters above
    rows = rows.sort_values(["doc_id", "text"], ignore_index=True)
    if rows.y.nunique() < 2:
        return None
    return fit(rows.text.tolist(), rows.y.to_numpy(dtype=np.float64))


def tag(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score, spans (array of start, end, p; code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            for at, texts in pieces(b.column(1), 1 << 20):
                if f is None:
                    s, spans = np.zeros(len(texts)), [[] for _ in range(len(texts))]
                else:
                    w = scan(texts)
                    x, p = document_features(f, w)
                    s, spans = sigmoid(x @ f.combine[:-1] + f.combine[-1]), toxic_spans(w, p)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(s), pa.array(spans, span)],
                                                 ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, score double, spans array<struct<start:bigint,end:bigint,p:double>>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score of THRESHOLD or more), spans."""
    return tag(docs, train(docs, labels)).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
