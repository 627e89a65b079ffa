"""XXH64 of many byte ranges at once, as numpy columns.

The algorithm is the published XXH64; the constants are fixed by it.
"""

from __future__ import annotations

import numpy as np

# Fixed values of XXH64: its five primes.
P1, P2, P3, P4, P5 = (
    np.uint64(11400714785074694791),
    np.uint64(14029467366897019727),
    np.uint64(1609587929392839161),
    np.uint64(9650029242287828579),
    np.uint64(2870177450012600261),
)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lane(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _turn(acc + word * P2, 31) * P1


def xxh64_ranges(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[starts[i]:starts[i] + lengths[i]] for each i, as uint64.

    `data` must have 8 bytes of padding after the last range.
    """
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint64)
    at64 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    at32 = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    s = np.uint64(seed)
    pos = starts.astype(np.int64)
    left = lengths.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, s + P5, np.uint64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            v = [np.full(len(long), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            p, rest, live = pos[long], left[long], np.arange(len(long))
            while len(live):
                for k in range(4):
                    v[k][live] = _lane(v[k][live], at64[p[live] + 8 * k])
                p[live] += 32
                rest[live] -= 32
                live = live[rest[live] >= 32]
            merged = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for k in range(4):
                merged = (merged ^ _lane(np.zeros(len(long), np.uint64), v[k])) * P1 + P4
            h[long] = merged
            pos[long], left[long] = p, rest
        h += lengths.astype(np.uint64)
        live = np.flatnonzero(left >= 8)
        while len(live):
            h[live] = _turn(h[live] ^ _lane(np.zeros(len(live), np.uint64), at64[pos[live]]), 27) * P1 + P4
            pos[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero(left >= 4)
        if len(live):
            h[live] = _turn(h[live] ^ (at32[pos[live]].astype(np.uint64) * P1), 23) * P2 + P3
            pos[live] += 4
            left[live] -= 4
        live = np.flatnonzero(left > 0)
        while len(live):
            h[live] = _turn(h[live] ^ (data[pos[live]].astype(np.uint64) * P5), 11) * P1
            pos[live] += 1
            left[live] -= 1
            live = live[left[live] > 0]
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h
