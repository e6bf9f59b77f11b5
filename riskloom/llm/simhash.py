"""Near-duplicate documents by SimHash fingerprints and BK-trees.

A fingerprint has 64 bits: each is 1 if it is set in over half of the XXH64 hashes of the
text's runs of three words.  Texts are linked if their fingerprints differ in at most
``RADIUS`` bits; components of links are classes.

Distinct fingerprints are dealt into shards.  Where bits are cut into ``RADIUS + 1``
groups, two linked fingerprints agree in one group at least, so a shard is a group of
bits and their value.  A shard of more than ``SHARD`` fingerprints is dealt again by the
bits that it does not fix, in the same way; distinct fingerprints that agree in all but
twelve bits are 4,096 at most, so this ends whatever the texts are, and a group of
very many near copies is never one task.  Each shard has a BK-tree: children are
keyed by their Hamming distance to the parent, and a search follows only the edges
within the radius of its own distance.  What a shard sends on is one row for each
fingerprint that is not the first of its links, never the pairs.

The trees are not broadcast to all tasks: a tree meets the fingerprints of its own shard
only, as others can't be within the radius by that group of bits.

Defined results: null, empty and blank texts have the fingerprint zero, linked like any
other; a null doc_id gets a class but names none unless all of its class are null; repeated
rows each get a row; columns but doc_id and text are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise
from riskloom.llm.components import components

WORDS = 3
SEED = 42
RADIUS = 3
SHARD = 1 << 12
BITS = 64
_AT_ONCE = 1 << 16  # fingerprints or pairs of them that a task handles at a time


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text."""
    words = text.encode().lower().split()  # bytes: A-Z, and the blanks 0x20, 0x09-0x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(WORDS, len(words))
    hash64 = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    firsts, lasts = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    for i in range(0, len(firsts), _AT_ONCE):
        h = np.array([hash64(line[a:b], SEED) for a, b in zip(firsts[i:i + _AT_ONCE], lasts[i:i + _AT_ONCE])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(firsts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint as a signed long) of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py() or "") for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


class Forest:
    """BK-trees of many shards: ``value`` distinct in each run of equal ``shard``.

    A node is the place of its fingerprint.  ``key`` is parent * 65 + distance of all nodes
    but roots, sorted, and ``child`` the node of each.
    """

    def __init__(self, value: np.ndarray, shard: np.ndarray) -> None:
        self.value = value
        n = len(value)
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.append(first, n)))
        left, at = np.setdiff1d(np.arange(n), first, assume_unique=True), self.root.copy()
        keys, children = [], []
        while len(left):
            # all that is left goes down one edge; the first along an edge becomes the node there
            key = at[left] * (BITS + 1) + self.distance(left, at[left])
            edge, head, along = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            children.append(left[head])
            at[left] = left[head][along]
            left = left[at[left] != left]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key = key[order]
        self.child = np.concatenate(children)[order] if keys else np.zeros(0, np.int64)

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.value[a] ^ self.value[b]).astype(np.int64)

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places within ``radius`` of each other, the smaller first, some at a time."""
        asked = np.arange(len(self.value))
        todo = [(asked[i:i + _AT_ONCE], self.root[i:i + _AT_ONCE]) for i in range(0, len(asked), _AT_ONCE)]
        while todo:
            q, node = todo.pop()
            d = self.distance(q, node)
            near = (d <= radius) & (q < node)
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.key, node * (BITS + 1) + np.maximum(d - radius, 1))
            high = np.searchsorted(self.key, node * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
            n = np.maximum(high - low, 0)
            places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            q, node = np.repeat(q, n), self.child[places]
            todo += [(q[i:i + _AT_ONCE], node[i:i + _AT_ONCE]) for i in range(0, len(q), _AT_ONCE)]

    def least(self, radius: int) -> np.ndarray:
        """The first place of each place's component of links."""
        label = np.arange(len(self.value))
        for a, b in self.links(radius):
            while True:
                a, b = label[a], label[b]
                apart = a != b
                if not apart.any():
                    break
                a, b = a[apart], b[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
        return label


def _groups(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` groups of ``bits``, of equal size but for one bit."""
    cut = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cut, cut[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _searched(shards: DataFrame, radius: int) -> DataFrame:
    """(a, b): fingerprint and the first one of its component in a shard, where they differ."""
    def found(mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        value = fp.view(np.uint64)
        own = value & mask.view(np.uint64)
        change = np.concatenate([[False], (mask[1:] != mask[:-1]) | (own[1:] != own[:-1])])
        label = Forest(value, np.cumsum(change)).least(radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = fp = np.zeros(0, np.int64)
        for b in batches:
            mask, fp = (np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate((mask, fp)))
            if len(fp) >= _AT_ONCE:  # all but the last shard, which may go on
                others = np.flatnonzero((mask != mask[-1]) | ((fp & mask) != (fp[-1] & mask[-1])))
                if len(others):
                    yield found(mask[:others[-1] + 1], fp[:others[-1] + 1])
                    mask, fp = mask[others[-1] + 1:], fp[others[-1] + 1:]
        if len(fp):
            yield found(mask, fp)

    by = ["mask", F.col("fp").bitwiseAND(F.col("mask"))]
    return shards.select("mask", "fp").repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(run, "a bigint, b bigint")


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b) whose components are those of the links between the distinct ``fp``."""
    spark, found = distinct.sparkSession, None
    fixed, rows = [0], distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    value = F.col("fp").bitwiseAND(F.col("mask"))
    while fixed:
        # the next masks of each mask of this round: 4 a mask, 4^rounds at most
        dealt = [(_signed(m), _signed(m | g)) for m in fixed for g in _groups([b for b in range(BITS) if not m >> b & 1], radius + 1)]
        rows = rows.join(F.broadcast(spark.createDataFrame(dealt, "mask bigint, next bigint")), "mask")
        rows = materialise(rows.select("fp", F.col("next").alias("mask")), "simhash_shards")
        # as many fingerprints as their free bits can tell apart are few enough
        many = (F.col("n") > shard) & (F.pow(F.lit(2.0), F.lit(BITS) - F.bit_count("mask")) > shard)
        full = rows.groupBy("mask", value.alias("value")).agg(F.count("*").alias("n")).where(many)
        full = materialise(full.select("mask", "value"), "simhash_full")
        fixed = [r.mask % (1 << BITS) for r in full.select("mask").distinct().collect()]
        keyed = rows.withColumn("value", value)
        ready = _searched(keyed.join(full, ["mask", "value"], "left_anti") if fixed else rows, radius)
        found = ready if found is None else found.union(ready)
        rows = keyed.join(full, ["mask", "value"], "left_semi").select("fp", "mask")
    return found


def classes(docs: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """doc_id, ``fp`` and component_id, the least doc_id of its component, of each document."""
    rows = materialise(fingerprints(docs), "simhash")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash_distinct")
    label = components(materialise(links(distinct, radius, shard), "simhash_links"))
    named = distinct.join(label, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = materialise(named, "simhash_named")
    least = materialise(named.groupBy("label").agg(F.min("least").alias("component_id")), "simhash_components")
    # written tables on both sides, so that a component or a fingerprint of very many rows can be split
    one = materialise(named.join(least, "label").select("fp", "component_id"), "simhash_classes")
    return rows.join(one, "fp").select("doc_id", "fp", "component_id")
