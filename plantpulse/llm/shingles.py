"""Word-shingle sets of whole texts, computed for an Arrow batch at a time.

Words are runs of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return, with A-Z lower-cased. A batch's bytes are hashed by
one wrapping prefix sum of byte values times powers of an odd number, so the
64-bit hash of any word is a difference of two prefix sums times an inverse
power; shingles combine the hashes of consecutive words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and each text's number of words."""
    size = np.array([len(x) for x in raw], np.int64)
    # a blank behind every text keeps words of different texts apart
    data = _LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    blank = _BLANK[data]
    edge = np.empty(len(data), bool)
    edge[0], edge[1:] = ~blank[0], blank[:-1] & ~blank[1:]
    start = np.flatnonzero(edge)
    edge[0], edge[1:] = False, blank[1:] & ~blank[:-1]
    end = np.flatnonzero(edge)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_BASE, len(data)), out=sums[1:])
    words = mix64((sums[end] - sums[start]) * _powers(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    borders = np.concatenate(([0], np.cumsum(size + 1)))
    counts = np.diff(np.searchsorted(start, borders))
    return words, counts


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (NULL: empty); a text of
    fewer than ``width`` words is one shingle, a text without words none."""
    words, counts = word_hashes([x or b"" for x in column.cast(pa.binary()).to_pylist()])
    out, at = [], 0
    for n in counts.tolist():
        own = words[at:at + n]
        at += n
        if not n:
            out.append(own)
            continue
        k = min(width, n)
        mixed = own[:n - k + 1] + np.uint64(k)
        for j in range(1, k):
            mixed = mixed * _BASE + own[j:n - k + 1 + j]
        mixed = np.sort(mix64(mixed))
        keep = np.ones(len(mixed), bool)
        np.not_equal(mixed[1:], mixed[:-1], out=keep[1:])
        out.append(mixed[keep])
    return out
