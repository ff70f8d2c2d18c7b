"""Whole-batch word arithmetic on Arrow string columns.

The helpers here turn one slice of a string column into numpy arrays of word
positions and 64-bit word hashes, so that operators run over a few million
bytes per numpy call. A word is a run of bytes outside ``\\x20`` and
``\\x09-\\x0D``; as those bytes never occur inside a multi-byte UTF-8
character, byte positions and code points agree on word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.
PASS_BYTES = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _coefficients(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_COEF = _coefficients(256)


def coefficients(n: int) -> np.ndarray:
    """The first ``n`` odd multipliers of the multilinear hash."""
    global _COEF
    if n > len(_COEF):
        _COEF = _coefficients(2 * n)
    return _COEF


def segment_hash(buf: np.ndarray, start: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
    """Multilinear hash of the byte segments that begin at ``start`` and run to the next start.

    ``use`` masks out bytes (white space after a word); they count as absent.
    """
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    first = start[0]
    span = np.diff(np.append(start, len(buf)))
    pos = np.arange(len(buf) - first) - np.repeat(start - first, span)
    val = (buf[first:].astype(np.uint64) + np.uint64(1)) * coefficients(int(span.max()))[pos]
    if use is not None:
        val[~use[first:]] = 0
    return np.add.reduceat(val, start - first)


@dataclass
class Words:
    """Words of a slice: byte bounds, owning row, 64-bit hash; ``first`` has each row's first word (n + 1 values)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(buf: np.ndarray, off: np.ndarray) -> Words:
    """Words of the texts ``buf[off[i]:off[i + 1]]``; a word never crosses a text's end."""
    space = SPACE[buf]
    solid = ~space
    begins, ends = solid.copy(), solid.copy()
    if len(buf):
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        full = off[:-1] < off[1:]
        lo, hi = off[:-1][full], off[1:][full] - 1
        begins[lo] = solid[lo]
        ends[hi] = solid[hi]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    h = segment_hash(buf, start, solid)
    return Words(start, end, row, mix64(h + (end - start).astype(np.uint64)), first)


def slices(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into (first row, rows, bytes, offsets) of about ``limit`` bytes; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    off = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to - at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def strings(column: pa.Array) -> list[str | None]:
    """A string column as Python texts; broken bytes become replacement characters."""
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()]


def per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row's range; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def windows(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words inside a row, and the index of each run's first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    coef = coefficients(width)
    acc = np.zeros(len(at), np.uint64)
    for k in range(width):
        acc += h[at + k] * coef[k]
    return mix64(acc), at
