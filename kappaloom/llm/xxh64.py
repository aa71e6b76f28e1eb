"""XXH64 of many slices of one buffer at a time, in numpy."""

from __future__ import annotations

import numpy as np

# Fixed values of the public XXH64 definition.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (
    11400714785074694791, 14029467366897019727, 1609587929392839161,
    9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_slices(data: bytes, begin: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of ``data[begin:end]`` for every pair, as uint64."""
    padded = data + b"\0" * 8
    n = len(data) + 1
    eight = np.ndarray((n,), "<u8", padded, 0, (1,))
    four = np.ndarray((n,), "<u4", padded, 0, (1,))
    one = np.frombuffer(padded, np.uint8)
    size = (end - begin).astype(np.int64)
    at = begin.astype(np.int64).copy()
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(size), s + P5)
        long = np.flatnonzero(size >= 32)
        if len(long):
            h[long] = _stripes(eight, at, long, size[long] // 32, s)
            at[long] += size[long] // 32 * 32
        h += size.astype(np.uint64)
        left = (begin + size) - at
        live = np.flatnonzero(left >= 8)
        while len(live):
            h[live] = _rotl(h[live] ^ _round(np.uint64(0), eight[at[live]]), 27) * P1 + P4
            at[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero(left >= 4)
        h[live] = _rotl(h[live] ^ (four[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
        at[live] += 4
        left[live] -= 4
        live = np.flatnonzero(left > 0)
        while len(live):
            h[live] = _rotl(h[live] ^ (one[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
            left[live] -= 1
            live = live[left[live] > 0]
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def _stripes(eight, at, rows, stripes, s):
    """The state of slices of 32 bytes and more after their whole stripes."""
    acc = [np.full(len(rows), x) for x in (s + P1 + P2, s + P2, s, s - P1)]
    live, step = np.arange(len(rows)), 0
    while len(live):
        place = at[rows[live]] + 32 * step
        for k in range(4):
            acc[k][live] = _round(acc[k][live], eight[place + 8 * k])
        step += 1
        live = live[stripes[live] > step]
    h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
    for a in acc:
        h = (h ^ _round(np.uint64(0), a)) * P1 + P4
    return h
