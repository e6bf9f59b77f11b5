"""Operator 2: byte-level BPE encoding and decoding by prefix dynamic programming.

For each byte prefix of a piece exactly one token can end its encoding: the one
whose predecessor (the last token of the remaining prefix) and itself survive as
two tokens when merged together.  ``PrefixTable`` stores that token for every
prefix.  Appending bytes extends the table without touching what is there, and an
edit recomputes only from the edited byte on.

Null texts count as empty; an empty text has no tokens.  Repeated rows and null ids
give one row each.  Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# most entries of a worker's memo tables; a full table is emptied, which costs time only
MEMO_PIECES, MEMO_PAIRS = 400_000, 500_000
# texts whose new pieces are encoded together
TOGETHER = 512


class Vocabulary:
    """Ranks of byte strings, as in a ``.tiktoken`` file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {r: b for b, r in ranks.items()}
        # the longest token that ends in given three bytes; shorter ones have at most 2
        self.reach: dict[bytes, int] = {}
        for b in ranks:
            self.reach[b[-3:]] = max(len(b), self.reach.get(b[-3:], 2))
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[tuple[int, bool], list[tuple[bytes, float]]] = {}

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """Plain merging by rank, to ``down_to`` parts; used on single tokens only."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``.

        None if merging its bytes never gives it; () stands for a single byte.
        """
        if token not in self._halves:
            data = self.token_bytes[token]
            two = self.merge(data, 2) if len(data) > 1 else []
            ok = len(two) < 2 or len(two) == 2 and self.ranks.get(two[0] + two[1]) == token
            self._halves[token] = tuple(self.ranks[p] for p in two) if ok else None
        return self._halves[token]

    def edge(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """Parts that lie at an end of ``token`` while it is merged.

        Each comes with the rank of the merge that takes it up; none takes up the
        whole token.
        """
        out = self._edges.get((token, right))
        if out is None:
            out, t, until = [], token, float("inf")
            while True:
                out.append((self.token_bytes[t], until))
                two = self.halves(t)
                if not two:
                    break
                until, t = t, two[1 if right else 0]
            self._edges[token, right] = out
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` stay two tokens when merged together.

        They don't if, at some point, a merge over their border ranks before those
        that take up the two parts beside it.  Of equal merges the left one goes
        first.
        """
        key = left << 32 | right
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            ok = self.halves(left) is not None and self.halves(right) is not None
            if ok:
                get, ends = self.ranks.get, self.edge(right, False)
                for a, until_a in self.edge(left, True):
                    for b, until_b in ends:
                        rank = get(a + b)
                        if rank is not None and rank < until_a and rank <= until_b:
                            ok = False
                            break
                    if not ok:
                        break
            self._pairs[key] = ok
        return ok


class PrefixTable:
    """The last token of the encoding of every prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, last = self.v, self.last
        self.data += more
        data, get, known, reach = bytes(self.data), v.ranks.get, v._pairs.get, v.reach.get
        for end in range(len(last) + 1, len(data) + 1):
            for begin in range(max(0, end - reach(data[max(0, end - 3):end], 2)), end):
                token = get(data[begin:end])
                if token is None:
                    continue
                if begin:
                    before = last[begin - 1]
                    ok = known(before << 32 | token)
                    if ok is None:
                        ok = v.compatible(before, token)
                else:
                    ok = v.halves(token) is not None
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}: the ranks lack a single byte")

    def truncate(self, n: int) -> None:
        del self.data[n:], self.last[n:]

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace bytes ``start:stop``; prefixes before ``start`` keep their entries."""
        tail = bytes(self.data[stop:])
        self.truncate(start)
        self.append(new + tail)

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.token_bytes[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes texts piece by piece; distinct pieces are encoded once per worker."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v = vocabulary
        self.split = regex.compile(pattern).findall
        self.printed = [str(i) for i in range(max(vocabulary.token_bytes, default=-1) + 1)]
        self.ids: dict[str, tuple[int, ...]] = {}

    def learn(self, texts: list[str]) -> list[list[str]]:
        """Split texts into pieces and encode the pieces not met before.

        In sorted order each piece reuses the table of the beginning that it shares
        with the one before.
        """
        split = [self.split(t) for t in texts]
        if len(self.ids) >= MEMO_PIECES:
            self.ids.clear()
        new = set().union(*split)
        new.difference_update(self.ids)
        table, before = PrefixTable(self.v), b""
        for data in sorted(p.encode() for p in new):
            whole = self.v.ranks.get(data)
            if whole is not None:
                self.ids[data.decode()] = (whole,)
                continue
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            table.truncate(same)
            table.append(data[same:])
            self.ids[data.decode()] = tuple(table.tokens())
            before = data
        return split

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.ids[p] for p in self.learn([text])[0]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.token_bytes.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker, kept between tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(Vocabulary.load(SparkFiles.get(path)), pattern)
    return _ENCODERS[path, pattern]


def ship(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file to every executor; returns its name there."""
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids``: the token ids of each whole text."""
    name = ship(df.sparkSession, path)
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(name, pattern)
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                split = e.learn([t or "" for t in part.column(1).to_pylist()])
                ids = pa.array([[i for p in found for i in e.ids[p]] for found in split], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``bytes``: the bytes that each row's ids stand for (null ids: none)."""
    name = ship(df.sparkSession, path)
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(name, ".")
        for b in batches:
            out = [e.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("bytes", T.BinaryType())])
    return df.select(id_col, ids_col).mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
            keep_ids: bool = False) -> DataFrame:
    """Encode and decode each whole text in one pass and keep the digests, ids on demand.

    ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256`` (bytes that the ids decode to), both lowercase hex.
    """
    name = ship(df.sparkSession, path)
    id_type = df.schema[id_col].dataType
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, sha = _encoder(name, pattern), hashlib.sha256
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                n_tokens, ids_sha, dec_sha, kept = [], [], [], []
                for found in e.learn([t or "" for t in part.column(1).to_pylist()]):
                    ids = list(chain.from_iterable(map(e.ids.__getitem__, found)))
                    n_tokens.append(len(ids))
                    ids_sha.append(sha(",".join(map(e.printed.__getitem__, ids)).encode()).hexdigest())
                    dec_sha.append(sha(e.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(np.array(ids, dtype=np.int32))
                cols = [part.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(n_tokens)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *kept]))))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
        *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids])
    return df.select(id_col, text_col).mapInArrow(run, schema)
