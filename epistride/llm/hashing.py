"""Vectorised hashing of words, shingles and windows over Arrow string buffers.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r, which in UTF-8 are exactly the matches of
``[^\\x20\\x09-\\x0D]+``. Hashes don't depend on the machine, the process or the batch. What decides that words, shingles or
windows are equal is made of the words' own bytes, or of cryptographic digests of long ones; sums over powers, which are
quicker but can be made to collide, only find candidates, deal out work or serve as features.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, BASE_INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP, STEP_INVERSE = U(0xD6E8FEB86659FD93), U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
#: Bytes hashed at once; powers for so many are kept.
SPAN = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * U(0xA0761D6478BD642F))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_KEPT: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(n, SPAN)
    if n > SPAN:
        return powers(BASE, n), powers(BASE_INVERSE, n)
    if n not in _KEPT:
        _KEPT[n] = powers(BASE, n), powers(BASE_INVERSE, n)
    return _KEPT[n]


@dataclass
class Words:
    """The words of some texts: byte positions in ``data``, and the word range of each text in ``first``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # text i has the words first[i] to first[i + 1]
    offsets: np.ndarray  # and the bytes offsets[i] to offsets[i + 1]

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the offset of each text, without copying where Arrow allows it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = False, inside: np.ndarray = ~_SPACE) -> Words:
    """Words of each text; ``inside`` tells the bytes that belong to words."""
    data, offsets = text_buffers(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = inside[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]  # where a text that isn't empty begins
    start[inner] = word[inner]
    end[inner[1:] - 1] = word[inner[1:] - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets).astype(np.int64) if n else np.zeros(len(offsets), np.int64), offsets)


def word_digests(words: Words) -> np.ndarray:
    """Two numbers that tell words apart: the bytes and length of words up to 15 bytes, of longer ones the BLAKE2b digest of 127 bits.

    The top bit of the second number says which of both it is.
    """
    sizes = words.ends - words.starts
    padded = np.concatenate([words.data, np.zeros(16, np.uint8)])
    eights = np.ndarray(len(words.data) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each position
    left = np.minimum(sizes, 15).astype(np.uint64) * U(8)
    out = np.empty((len(sizes), 2), np.uint64)
    out[:, 0] = eights[words.starts] & _low_bits(np.minimum(left, U(64)))
    out[:, 1] = (eights[words.starts + 8] & _low_bits(np.maximum(left, U(64)) - U(64))) | left << U(53)
    for i in np.flatnonzero(sizes > 15).tolist():
        made = hashlib.blake2b(words.data[words.starts[i] : words.ends[i]], digest_size=16).digest()
        out[i] = np.frombuffer(made, "<u8")
        out[i, 1] |= U(1 << 63)
    return out


def _low_bits(n: np.ndarray) -> np.ndarray:
    """The lowest ``n`` bits set, for n from 0 to 64."""
    return np.where(n >= 64, U(0xFFFFFFFFFFFFFFFF), (U(1) << (n & U(63))) - U(1))


def word_hashes(digests: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, for candidates only."""
    return mix(digests[:, 0] ^ mix(digests[:, 1]))


def shingle_key(k: int, secret: bytes | None = None) -> np.ndarray:
    """Random multipliers for hashes of ``k`` words, drawn anew unless ``secret`` is given."""
    rng = np.random.Generator(np.random.Philox(key=int.from_bytes(secret or os.urandom(16), "little")))
    return rng.integers(0, 1 << 64, (2, 4 * k + 1), np.uint64)


def shingle_hashes(digests: np.ndarray, k: int, key: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``k`` words from each position on (the last k - 1 have none), by the ``key`` of k words or more.

    Each half is the upper half of a sum of the words' 32-bit parts times random 64-bit numbers: a multilinear hash, with
    which any two different shingles, whatever their words, collide with a probability of 2**-64 over the draws of the key. Who doesn't know
    the key can't make two that do. Fewer words than the key is for are hashed as if zeros followed, which no word is.
    """
    n = max(0, len(digests) - k + 1)
    parts = np.ascontiguousarray(digests).view(np.uint32).reshape(-1, 4).T.astype(np.uint64)
    halves = []
    for row in key:
        h = np.full(n, row[0])
        for j in range(k):
            for c in range(4):
                h += parts[c, j : j + n] * row[1 + 4 * j + c]
        halves.append(h >> U(32))
    return halves[0] << U(32) | halves[1]


def window_digests(digests: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The 128-bit BLAKE2b digest of the ``k`` word digests from each position in ``at``, as two numbers."""
    data = memoryview(np.ascontiguousarray(digests).reshape(-1).view(np.uint8))
    size = 16 * k
    parts = []
    for some in np.array_split(16 * at, len(at) // 65536 + 1):
        parts.append(b"".join([hashlib.blake2b(data[i : i + size], digest_size=16).digest() for i in some.tolist()]))
    return np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges that begin in ascending order, to deal them out."""
    out = np.empty(len(starts), np.uint64)
    for lo, _, at, total, inverse in span_totals(data, starts, ends):
        out[at] = totals_hash(total, inverse, starts[at] - lo, ends[at] - lo)
    return out


def span_totals(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Goes through ranges in bounded pieces: first and last byte, the slice of ranges, running totals, inverse powers."""
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + SPAN, side="right")))
        hi = int(ends[j - 1])
        power, inverse = _powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_SYMBOL[data[lo:hi]] * power[: hi - lo], out=total[1:])
        yield lo, hi, slice(i, j), total, inverse
        i = j


def totals_hash(total: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(inverse) <= (int(a.max()) if len(a) else 0):
        inverse = powers(BASE_INVERSE, int(a.max()) + 1)
    return mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * STEP)


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which ``k`` words of one text begin, and the windows of each text."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    total = int(counts.sum())
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.arange(total) + np.repeat(first[:-1] - begin, counts), counts


def window_hashes(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each position in ``at``, for candidates only."""
    if not len(at):
        return np.zeros(0, np.uint64)
    n = len(words)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(STEP, n), out=total[1:])
    return mix((total[at + k] - total[at]) * powers(STEP_INVERSE, n)[at] + U(k))


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    if not len(keys):
        return []
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[i] to starts[i] + counts[i] - 1, for each i in turn."""
    begin = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - begin, counts)
