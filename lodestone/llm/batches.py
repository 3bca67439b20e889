"""NumPy views of Arrow batches of text, shared by the Python-side operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once by a Python worker.
SLICE_BYTES = 1 << 20

WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. offsets has len(col) + 1 entries."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = col.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most limit bytes together; a longer row stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets from 0) for slices of limited size."""
    for batch in batches:
        data, off = utf8(batch.column(column))
        for lo, hi in slices(off, limit):
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def collapse(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each run of white space by one space, in every text by itself."""
    if not len(data):
        return data, off
    ws = WS[data]
    again = np.zeros(len(data), bool)
    again[1:] = ws[1:] & ws[:-1]
    starts = off[:-1][off[:-1] < off[1:]]
    again[starts] = False
    out = np.where(ws, np.uint8(0x20), data)[~again]
    gone = np.zeros(len(off), np.int64)
    gone[1:][off[:-1] < off[1:]] = np.add.reduceat(again, starts, dtype=np.int64)
    return out, off - np.cumsum(gone)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every word `[^\\x20\\x09-\\x0D]+`; words do not cross texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~WS[data]
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | first[1:n]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | first[1:n]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(off, start, side="right") - 1


def word_end(data: np.ndarray, at: int) -> int:
    """The first white space from `at` on, or the end."""
    while at < len(data):
        white = WS[data[at : at + (1 << 16)]]
        if white.any():
            return at + int(white.argmax())
        at += len(white)
    return len(data)


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def tidy(run):
    """run, which after its last batch gives freed memory back to the system: workers wait for their next task with what
    they hold, and a task may have two of them."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = _libc()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return inner
