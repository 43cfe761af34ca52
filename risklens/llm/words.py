"""Vectorised splitting of texts into hashed words.

Helpers for Arrow stages: a whole slice of a text column is split and hashed
with numpy over the column's UTF-8 buffer, so Python does no work per word.
Slices are bounded in bytes (a longer text forms a slice of its own), which
bounds memory whatever Spark's batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of unsigned 64-bit integers."""
    x = x + _ODD
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(256, dtype=np.uint64)) | _U(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of a word as the contracts define it: all but space and tab to CR.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of a bare word: ASCII letters and digits, and all of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __reduce__(self):  # each task builds its own tables
        return _Powers, ()

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            made = []
            for base in (_BASE, _INVERSE):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            if size > 4 * SLICE_BYTES:  # a rare very long text: don't keep its tables
                return made[0], made[1]
            self.up, self.down = made
        return self.up, self.down


_POWERS = _Powers()


class Slice:
    """Texts of some rows as one byte buffer.

    ``data``: bytes, ``offsets``: row i is ``data[offsets[i]:offsets[i + 1]]``
    (a null text is empty), ``first``: number of the first row in its batch.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.rows = len(offsets) - 1

    def lowered(self, latin: bool = False) -> np.ndarray:
        """The bytes with A-Z lower-cased; ``latin``: also the letters U+00C0 to U+00DE."""
        out = _LOWER[self.data]
        if latin and len(out) > 1:
            second = out[1:]
            second[(self.data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
        return out

    def words(self, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words (runs of bytes of ``kind`` within a
        row), and for each row the number of the first word at or after it
        (``rows + 1`` entries)."""
        inside = kind[self.data]
        n = len(inside)
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        after[edges - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets, side="left")

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True, latin: bool = False) -> np.ndarray:
        """64-bit hash of each word's (lower-cased) bytes, equal for equal words."""
        n = len(self.data)
        up, down = _POWERS.to(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.lowered(latin) if lower else self.data] * up[:n], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into slices of at most ``limit`` bytes or one row."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=width)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield Slice(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], first)
        first = last


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """The same cut, as Python strings (null: empty), for work on whole characters."""
    for s in slices(column, limit):
        yield s.first, [x or "" for x in column.slice(s.first, s.rows).to_pylist()]


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i; empty segments give 0."""
    sums = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all segments ``[starts[i], starts[i] + sizes[i])``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def kept(key: str, make):
    """An object made once in this Python process and kept for later tasks that
    Spark runs in it (a dictionary that is costly to read, a cache of words)."""
    import sys
    import types

    store = sys.modules.setdefault("_kept_by_tasks", types.ModuleType("_kept_by_tasks")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
