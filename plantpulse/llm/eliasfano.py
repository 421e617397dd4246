"""Elias-Fano sequences: sorted integers in about 2 + log2(universe / n) bits
each, with vectorised access, selection and search over a plain buffer (memory
mapped or not)."""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<QQQQ")
_ONE = np.uint64(1)


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits, lowest bit first, padded for 8-byte reads."""
    if not width:
        return b"\0" * 8
    parts = []
    block = 1 << 16  # a multiple of 8: blocks end on a byte
    for lo in range(0, len(values), block):
        raw = values[lo:lo + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(raw, axis=1, count=width, bitorder="little")
        parts.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(parts) + b"\0" * 8


def select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) set bit of each word."""
    place = np.zeros(len(word), np.int64)
    word, r = word.copy(), r.copy()
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        up = r >= ones
        r -= np.where(up, ones, 0)
        place += np.where(up, width, 0)
        word = np.where(up, word >> np.uint64(width), word)
    return place


class Bits:
    """A bit vector of 64-bit words with selection of ones and zeros."""

    def __init__(self, words: np.ndarray):
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        before = self.ones if one else self.zeros
        at = np.searchsorted(before, k, side="right") - 1
        word = self.words[at]
        return at * 64 + select_in_word(word if one else ~word, k - before[at])


class Packed:
    """Values of a fixed number of bits."""

    def __init__(self, buffer, n: int, width: int, offset: int):
        size = (n * width + 7) // 8 + 8
        raw = np.frombuffer(buffer, np.uint8, size, offset)
        # every byte offset as the start of an 8-byte word
        self.words = np.ndarray((size - 7,), "<u8", raw, 0, (1,))
        self.width, self.mask, self.end = width, np.uint64((1 << width) - 1), offset + size

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        return (self.words[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask


class EliasFano:
    """``n`` sorted values below ``universe`` (1 to 2**64)."""

    def __init__(self, buffer, offset: int = 0):
        self.n, self.most, self.low_bits, size = HEAD.unpack_from(buffer, offset)
        at = offset + HEAD.size
        self.high = Bits(np.frombuffer(buffer, "<u8", size, at))
        self.low = Packed(buffer, self.n, self.low_bits, at + 8 * size)
        self.end = self.low.end

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        # one zero closes every high value, one more for the search bounds
        bits = np.zeros((n + (universe >> low_bits) + 2 + 63) // 64 * 64, np.uint8)
        bits[high] = 1
        words = np.packbits(bits, bitorder="little")
        low = pack_bits(values & np.uint64((1 << low_bits) - 1), low_bits)
        return HEAD.pack(n, universe - 1, low_bits, len(words) // 8) + words.tobytes() + low

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        high = (self.high.select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self.low[i]

    def access_pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places ``i`` and ``i + 1``: the second one's bit mostly
        follows in the same word."""
        at = self.high.select(i, True)
        rest = (self.high.words[at >> 6] >> (at & 63).astype(np.uint64)) >> _ONE
        then = at + 1 + np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        then[far] = self.high.select(i[far] + 1, True)
        shift = np.uint64(self.low_bits)
        return tuple((((p - k).astype(np.uint64) << shift) | self.low[k]).astype(np.int64) for p, k in ((at, i), (then, i + 1)))

    def decode(self) -> np.ndarray:
        """All values."""
        i = np.arange(self.n, dtype=np.int64)
        bits = np.unpackbits(self.high.words.view(np.uint8), bitorder="little")
        high = (np.flatnonzero(bits)[:self.n] - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self.low[i]

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1: the successor inside the run of equal
        high parts, by bisection over the low parts."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        inside = values <= np.uint64(self.most)
        high = np.where(inside, high, 0)
        first = np.where(high > 0, self.high.select(np.maximum(high - 1, 0), False) + 1, 0) - high
        last = self.high.select(high, False) - high
        target = values & np.uint64((1 << self.low_bits) - 1)
        lo, hi = first.copy(), last.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low[mid] < target[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        hit = np.flatnonzero(inside & (lo < last))
        hit = hit[self.low[lo[hit]] == target[hit]]
        out[hit] = lo[hit]
        return out
