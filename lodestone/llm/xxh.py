"""XXH64 of many byte ranges of one buffer at once, in NumPy."""

from __future__ import annotations

import numpy as np

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def _at(data: np.ndarray, kind: str) -> np.ndarray:
    """The little-endian numbers that start at every byte; data is padded behind."""
    size = np.dtype(kind).itemsize
    return np.ndarray((len(data) - size + 1,), kind, data, strides=(1,))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hashes of data[start:start + size], unsigned. data must have 8 spare bytes behind the last range."""
    with np.errstate(over="ignore"):
        return _xxh64(np.ascontiguousarray(data), start.astype(np.int64), size.astype(np.int64), np.uint64(seed))


def _xxh64(data, start, size, seed):
    u64, u32 = _at(data, "<u8"), _at(data, "<u4")
    h = np.full(len(start), seed + P5, np.uint64)
    at = start.copy()
    end = start + size
    long = np.flatnonzero(size >= 32)
    if len(long):
        v = [np.full(len(long), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        p, stop = at[long], end[long] - 32
        live = np.arange(len(long))
        while len(live):
            for k in range(4):
                v[k][live] = _round(v[k][live], u64[p[live] + 8 * k])
            p[live] += 32
            live = live[p[live] <= stop[live]]
        x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for k in range(4):
            x = (x ^ _round(np.uint64(0), v[k])) * P1 + P4
        h[long], at[long] = x, p
    h += size.astype(np.uint64)
    live = np.flatnonzero(end - at >= 8)
    while len(live):
        h[live] = _rotl(h[live] ^ _round(np.uint64(0), u64[at[live]]), 27) * P1 + P4
        at[live] += 8
        live = live[end[live] - at[live] >= 8]
    live = np.flatnonzero(end - at >= 4)
    if len(live):
        h[live] = _rotl(h[live] ^ (u32[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
        at[live] += 4
    live = np.flatnonzero(end > at)
    while len(live):
        h[live] = _rotl(h[live] ^ (data[at[live]].astype(np.uint64) * P5), 11) * P1
        at[live] += 1
        live = live[end[live] > at[live]]
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    return h
