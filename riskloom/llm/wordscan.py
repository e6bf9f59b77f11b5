"""Vectorised word scan of an Arrow string column.

A word is a run of ASCII digits, ASCII letters (A-Z lower-cased) and bytes from
0x80 on, that is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text.
Hashes are 64-bit; equal words always have equal hashes, and callers verify what
hashes propose wherever a collision could change a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S31, _S29 = np.uint64(31), np.uint64(29)
_BLOCK = 1 << 14  # values that are scrambled at a time, so that they stay in the cache
# keeps the first n bytes of a little-endian 8-byte lane
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    out = np.empty_like(h)
    for at in range(0, len(h), _BLOCK):
        part, to = h[at:at + _BLOCK], out[at:at + _BLOCK]
        shifted = part >> _S31
        np.bitwise_xor(part, shifted, out=to)
        to *= _M1
        np.right_shift(to, _S29, out=shifted)
        to ^= shifted
        to *= _M2
        np.right_shift(to, _S31, out=shifted)
        to ^= shifted
    return out


@dataclass
class Words:
    """Words of a run of texts, in order.

    ``first[i]:first[i+1]`` are the words of text ``i``; ``start``/``end`` are
    byte offsets into ``data`` (lower-cased), ``hash`` is each word's hash,
    ``text_start`` where each text begins.
    """

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text_start: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls, offsets from 0."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[off[0]:off[-1]]
    return raw, off - off[0]


def pieces(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about ``most`` bytes, with the index of their first.

    A longer text is a run of its own; this only bounds working memory.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def scan(texts: pa.Array) -> Words:
    raw, off = buffers(texts)
    n = len(raw)
    data = np.zeros(n + 8, dtype=np.uint8)  # so that 8 bytes can be read at any start
    upper = (raw - np.uint8(65) < np.uint8(26)).view(np.uint8)  # differences wrap around, so one comparison is a range
    upper <<= np.uint8(5)
    np.bitwise_or(raw, upper, out=data[:n])
    word = data[:n + 1] >= np.uint8(128)
    word |= data[:n + 1] - np.uint8(97) < np.uint8(26)
    word |= data[:n + 1] - np.uint8(48) < np.uint8(10)
    word[n:] = False
    edge = np.empty(n + 1, dtype=bool)  # a word starts here, before knowing of text ends
    edge[0] = word[0]
    np.logical_and(word[1:], ~word[:-1], out=edge[1:])
    inner = off[1:-1]
    cut = inner[(inner > 0) & (inner < n)]
    cut = np.unique(cut[word[cut] & word[cut - 1]])  # a word runs over a text's end
    edge[cut] = True
    start = np.flatnonzero(edge)
    stop = np.empty(n + 1, dtype=bool)
    stop[0] = False
    np.logical_and(word[:-1], ~word[1:], out=stop[1:])
    stop[cut] = True
    end = np.flatnonzero(stop)
    size = end - start
    lanes = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=data, strides=(1,))
    h = mix(lanes[start] & _KEEP[np.minimum(size, 8)])
    more, at = np.flatnonzero(size > 8), 8
    while len(more):
        left = size[more] - at
        h[more] = mix(h[more] * _M2 + (lanes[start[more] + at] & _KEEP[np.minimum(left, 8)]))
        at += 8
        more = more[left > 8]
    first = np.searchsorted(start, off)
    return Words(data, first, start, end, h, off[:-1])


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words inside each text.

    Returns (hash, index of the text, index of the run's first word).  A text of
    1 to k-1 words gives one shorter run over all its words, one of none gives none.
    """
    counts, n = w.counts, len(w.hash)
    runs = np.maximum(counts - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(w.first[:-1], runs)
    if n >= k:
        roll = w.hash[:n - k + 1].copy()
        for j in range(1, k):
            roll = roll * _M2 + w.hash[j:n - k + 1 + j]
        h = mix(roll[at])
    else:
        h = np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        acc, s0 = w.hash[w.first[short]].copy(), w.first[short]
        for j in range(1, k - 1):
            go = counts[short] > j
            acc[go] = acc[go] * _M2 + w.hash[s0[go] + j]
        h = np.concatenate([h, mix(acc ^ _M1)])
        owner = np.concatenate([owner, short])
        at = np.concatenate([at, s0])
        order = np.argsort(owner, kind="stable")
        h, owner, at = h[order], owner[order], at[order]
    return h, owner, at
