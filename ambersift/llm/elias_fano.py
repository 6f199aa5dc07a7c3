"""Elias-Fano sequences as plain arrays, searched many values at a time.

A sorted sequence of ``n`` numbers below ``u`` is stored as ``log2(u / n)`` low bits each,
packed, and the high parts in unary, about two bits each. A directory holds the number
of zeros before every 64 bits of the unary part. All arrays are 64-bit words, so a file
of them can be mapped and searched without being read.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    out = np.zeros(-(-len(packed) // 8) * 8 + 8, np.uint8)  # a spare word: reads may straddle
    out[: len(packed)] = packed
    return out.view(np.uint64)


def _nth_one(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the ``r``-th set bit (from 0) of each word."""
    at, r = np.zeros(len(word), np.uint64), r.astype(np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        low = (word >> at) & np.uint64((1 << width) - 1)
        n = np.bitwise_count(low).astype(np.uint64)
        over = r >= n
        r = r - n * over
        at = at + np.uint64(width) * over.astype(np.uint64)
    return at.astype(np.int64)


class EliasFano:
    """``meta``: n and the number of low bits; ``low``, ``high``, ``zeros``: arrays."""

    def __init__(self, meta: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits = int(meta[0]), int(meta[1])
        self.meta, self.low, self.high, self.zeros = meta, low, high, zeros
        self._ones: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, min(63, (max(1, universe) // max(1, n)).bit_length() - 1))
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.concatenate(
            [((part[:, None] >> shifts) & _ONE).astype(np.uint8).ravel() for part in np.array_split(values, max(1, n // 100_000))]
        )
        top = (values >> np.uint64(bits)).astype(np.int64)
        high = np.zeros(n + (max(1, universe) - 1 >> bits) + 2, np.uint8)
        high[top + np.arange(n)] = 1
        words = _words(high)
        ones = np.bitwise_count(words).astype(np.int64)
        zeros = 64 * np.arange(len(words)) - (np.cumsum(ones) - ones)
        return cls(np.array([n, bits], np.uint64), _words(low), words, zeros.view(np.uint64))

    def arrays(self) -> list[np.ndarray]:
        return [self.meta, self.low, self.high, self.zeros]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = self.low[word] >> shift
        # A shift by 64 is undefined, so the second word is moved in two steps.
        second = (self.low[word + 1] << (np.uint64(63) - shift)) << _ONE
        return (first | second) & np.uint64((1 << self.bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the ``k``-th zero (from 0) in the unary part."""
        before = self.zeros.view(np.int64)
        word = np.searchsorted(before, k, "right") - 1
        return word * 64 + _nth_one(self.high[word] ^ _FULL, k - before[word])

    def _ones_from(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many ones stand from ``at`` on, before the ``k``-th zero."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        window = (self.high[word] >> shift) | ((self.high[word + 1] << (np.uint64(63) - shift)) << _ONE)
        gap = window ^ _FULL
        out = np.bitwise_count((gap & (~gap + _ONE)) - _ONE).astype(np.int64)
        far = np.flatnonzero(gap == 0)
        out[far] = self._zero(k[far]) - at[far]
        return out

    def value(self, i: np.ndarray) -> np.ndarray:
        """The numbers at ``i``."""
        if self._ones is None:
            self._ones = 64 * np.arange(len(self.zeros)) - self.zeros.view(np.int64)
        before = self._ones
        word = np.searchsorted(before, i, "right") - 1
        at = word * 64 + _nth_one(self.high[word], i - before[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def span(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at ``i`` and at ``i + 1``."""
        if self._ones is None:
            self._ones = 64 * np.arange(len(self.zeros)) - self.zeros.view(np.int64)
        word = np.searchsorted(self._ones, i, "right") - 1
        at = word * 64 + _nth_one(self.high[word], i - self._ones[word])
        after = at + 1
        word, shift = after >> 6, (after & 63).astype(np.uint64)
        window = (self.high[word] >> shift) | ((self.high[word + 1] << (np.uint64(63) - shift)) << _ONE)
        after += np.bitwise_count((window & (~window + _ONE)) - _ONE).astype(np.int64)
        bits = np.uint64(self.bits)
        ends = ((after - i - 1).astype(np.uint64) << bits) | self._low(i + 1)
        far = np.flatnonzero(window == 0)
        ends[far] = self.value(i[far] + 1)
        return ((at - i).astype(np.uint64) << bits) | self._low(i), ends

    def find(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each ``x`` (below the universe), -1 if it is not there: the successor
        within its high part, and within ``first`` to ``end`` if given."""
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return np.full(len(x), -1)
        top, want = (x >> np.uint64(self.bits)).astype(np.int64), x & np.uint64((1 << self.bits) - 1)
        start = np.zeros(len(x), np.int64)  # where the numbers with this high part start in the unary part
        later = top > 0
        start[later] = self._zero(top[later] - 1) + 1
        lo = start - top
        hi = lo + self._ones_from(start, top)
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, end)
        stop = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        out = np.full(len(x), -1)
        inside = np.flatnonzero(lo < stop)
        hit = inside[self._low(lo[inside]) == want[inside]]
        out[hit] = lo[hit]
        return out
