"""Words of whole Arrow text columns as arrays: bounds, rows and 64-bit hashes.

A word is a maximal run of bytes other than blank, tab, LF, VT, FF and CR; a null
text has none. A word's hash is a polynomial of its bytes modulo 2**64, mixed;
equal words have equal hashes, different ones differ but for a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 21  # bytes worked on at once; a longer text makes a chunk of its own

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept by the worker up to a chunk's length."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK) if n <= CHUNK else max(n, 2 * CHUNK)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 2 * CHUNK:
            return up, down
        _POWERS.update(up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def absent(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the sorted ``values`` are not among the sorted ``known`` ones."""
    if not len(known):
        return np.ones(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] != values


def table(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_IS_BLANK = table(BLANKS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each row starts, the end included."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one longer row."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


class Words:
    """Words of a few rows: ``start`` and ``end`` in ``data``, ``hash``, and ``at``,
    the place of each row's first word, the end included."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, lower: bool = False, cut: np.ndarray | None = None):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        solid = ~_IS_BLANK[data]
        first = np.ones(n + 1, bool)
        first[1:n] = ~solid[:-1] if n > 1 else first[1:n]
        first[rows] = True
        if cut is not None:
            first[cut] = True
        self.start = np.flatnonzero(solid & first[:-1])
        last = solid.copy()
        if n:
            last[:-1] &= ~solid[1:] | first[1:n]
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, rows)
        self._solid = solid

    @property
    def hash(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _powers(len(self.data))
        value = (self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)]
        value[~self._solid] = 0
        return mix(np.add.reduceat(value, self.start) * down[self.start])

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def words_of(column: pa.Array, lower: bool = False, most: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over a column, chunk by chunk."""
    data, at = text_bytes(column)
    for a, b in row_chunks(at, most):
        yield a, b, Words(data[at[a] : at[b]], at[a : b + 1] - at[a], lower)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every ``n`` consecutive word hashes (mixed; empty if fewer)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1])


def whole(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """For words of rows ``at``: which of the ``total - n + 1`` windows lie in one row."""
    if total < n:
        return np.zeros(0, bool)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(total)
    return left[: total - n + 1] >= n
