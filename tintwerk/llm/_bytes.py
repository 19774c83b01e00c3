"""Vectorised hashing over the UTF-8 buffers of Arrow string columns.

A batch of texts is one byte array with row offsets; hashes of any substring come from prefix sums of a
polynomial modulo 2**64 over random byte values, finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULTIPLIER = 0xD1342543DE82EF95
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUES, _OTHER_VALUES = (np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False) for seed in (20240607, 20240608))

_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0..n-1 and those of its inverse, kept for the next call."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Prefix:
    """Prefix sums of one byte array; ``hashes(start, end)`` gives a 64-bit hash of each [start, end).

    ``other``: a second family of hashes, independent of the first; both together have 128 bits.
    """

    def __init__(self, data: np.ndarray, fold: np.ndarray | None = None, other: bool = False):
        n = len(data)
        up, self._down = powers(n + 1)
        table = _OTHER_VALUES if other else _BYTE_VALUES
        values = (table if fold is None else table[fold])[data]
        values *= up[:n]
        self._sums = np.zeros(n + 1, U)
        np.cumsum(values, out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(U))

    def windows(self, k: int) -> np.ndarray:
        """The hash of every k bytes, in order."""
        n = len(self._sums) - k
        return mixed((self._sums[k:] - self._sums[:n]) * self._down[:n] + U(k))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text has a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n, at + 50_000)
        yield at, to
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of each row: their starts, ends, 64-bit hashes, and len+1 offsets by row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner], after[inner - 1] = False, False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, Prefix(data, _LOWER if lower else None).hashes(start, end), np.searchsorted(start, offsets)


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


_SHINGLE = np.random.default_rng(7).integers(1, 1 << 63, 8, dtype=np.uint64) | U(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct word shingles as 64-bit hashes, and len+1 offsets by row.

    A row of fewer words than ``size`` has its whole sequence as its one shingle; a row without words has none.
    """
    _, _, h, at = words(data, offsets)
    counts = np.diff(at)
    full = np.maximum(counts - size + 1, counts > 0)
    ends = np.cumsum(full)
    first = np.repeat(at[:-1], full) + spread(full)
    total = np.zeros(len(first), U)
    short = np.flatnonzero((counts > 0) & (counts < size))
    long = np.ones(len(first), bool)
    long[ends[short] - 1] = False
    for k in range(size):
        total[long] += h[first[long] + k] * _SHINGLE[k]
    if len(short):
        extra = np.full(len(short), 0x51ED, U) + counts[short].astype(U)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] += h[at[short[has]] + k] * _SHINGLE[k]
        total[ends[short] - 1] = extra
    keys = mixed(total)
    # Row by row: texts are short beside a slice, so each sort stays in the cache.
    for i, j in zip((ends - full).tolist(), ends.tolist(), strict=True):
        if j - i > 1:
            keys[i:j].sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[(ends - full)[full > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return keys[new], kept[np.concatenate([[0], ends])]
