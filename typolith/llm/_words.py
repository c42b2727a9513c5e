"""Vectorised word hashing over Arrow string buffers.

Words are runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased. A word's identity is a
64-bit hash: a polynomial in its bytes, finished by a mixing step over value and length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes hashed in one vectorised step; longer texts are cut between words.
CHUNK = 1 << 20
_tables: dict[str, np.ndarray] = {}


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same step of mapInArrow, with its memory given back when the task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    table = _tables.get(name)
    if table is None or len(table) < n:
        size = max(n, CHUNK + 1)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        _tables[name] = table
    return table[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (rows + 1) and bytes of a string column; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _hash_span(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and word starts of one span; firsts: where texts begin in it."""
    data = LOWER[data]
    blank = SPACE[data]
    begins, ends = ~blank, ~blank
    left = np.ones(len(data), bool)
    left[1:] = blank[:-1]
    left[firsts] = True
    right = np.ones(len(data), bool)
    right[:-1] = blank[1:]
    right[firsts[firsts > 0] - 1] = True
    starts, stops = np.flatnonzero(begins & left), np.flatnonzero(ends & right) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, len(data)), out=total[1:])
    value = (total[stops] - total[starts]) * _powers("down", _INVERSE, len(data) + 1)[starts]
    return mix(value + mix((stops - starts).astype(np.uint64))), starts


def hashed_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, word offsets by row) for runs of whole rows."""
    offsets, data = buffers(column)
    rows, row = len(offsets) - 1, 0
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[end])
        if hi - lo <= CHUNK:
            if hi == lo:
                yield row, end, np.zeros(0, np.uint64), np.zeros(end - row + 1, np.int64)
            else:
                firsts = offsets[row:end] - lo
                hashes, starts = _hash_span(data[lo:hi], firsts[firsts < hi - lo])
                yield row, end, hashes, np.searchsorted(starts, offsets[row : end + 1] - lo)
        else:  # one long text: cut it at blanks
            parts, at = [], lo
            while at < hi:
                cut = min(hi, at + CHUNK)
                while cut < hi:
                    blanks = np.flatnonzero(SPACE[data[at:cut]])
                    if len(blanks):
                        cut = at + int(blanks[-1]) + 1
                        break
                    cut = min(hi, cut + CHUNK)
                parts.append(_hash_span(data[at:cut], np.zeros(1, np.int64))[0])
                at = cut
            hashes = np.concatenate(parts)
            yield row, end, hashes, np.array([0, len(hashes)])
        row = end


def words_of(text: str | None) -> list[str]:
    """The same words as strings; for tests and small inputs."""
    out = (text or "").encode("utf-8", "replace").lower()
    return [w.decode("utf-8", "replace") for w in out.split()]
