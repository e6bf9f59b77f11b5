"""The first four bytes of many MD5 digests (RFC 1321) at once, in numpy.

Spark's ``md5`` of one key a row and draw costs a digest object, a string and its hex digits each time.
Where only a key's first hex digits decide (a draw that keeps few rows), the rounds run here over all
keys of one length: the same digests as ``md5``, as 32-bit operations on whole columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]


def _block(state: list[np.ndarray], words: list[np.ndarray | int]) -> list[np.ndarray]:
    """The state after one block of 16 words; a number is a word that all messages share."""
    a, b, c, d = (s.copy() for s in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words[_WORD[i]]
        if isinstance(word, int):
            f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        else:
            f += np.uint32(_SINES[i])
            f += word
        f += a
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=t)
        f >>= np.uint32(32 - _SHIFTS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [s + x for s, x in zip(state, (a, b, c, d), strict=True)]


def md5_heads(prefixes: np.ndarray, tails: list[bytes]) -> list[np.ndarray]:
    """For each tail the first four bytes, as numbers, of the digests of prefix + tail; ``prefixes`` has one row of bytes each."""
    n, length = prefixes.shape
    padded = np.zeros((n, -(-length // 4) * 4), np.uint8)
    padded[:, :length] = prefixes
    own = np.ascontiguousarray(padded.view("<u4").astype(np.uint32).T)
    out = []
    for tail in tails:
        size = length + len(tail)
        rest = bytes(length) + tail + b"\x80" + bytes((55 - size) % 64) + (8 * size).to_bytes(8, "little")
        words: list[np.ndarray | int] = [int(w) for w in np.frombuffer(rest, "<u4")]
        for i, w in enumerate(own):
            words[i] = w | np.uint32(words[i])
        state = [np.full(n, s, np.uint32) for s in _START]
        for at in range(0, len(words), 16):
            state = _block(state, words[at:at + 16])
        out.append(state[0].byteswap())
    return out


def drawn(prefixes: pa.Array, tails: list[bytes], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, tail) of all pairs whose digest of prefix + tail starts with a number below ``limit``."""
    text = prefixes.cast(pa.large_binary())
    offset = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    size = np.diff(offset)
    rows, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length in np.unique(size):
        same = np.flatnonzero(size == length)
        bytes_of = data[offset[same][:, None] + np.arange(length)] if length else np.zeros((len(same), 0), np.uint8)
        for i, head in enumerate(md5_heads(bytes_of, tails)):
            kept = same[head < limit]
            rows.append(kept)
            at.append(np.full(len(kept), i))
    return np.concatenate(rows), np.concatenate(at)
