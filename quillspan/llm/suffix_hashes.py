"""Hashes of strings by prefix sums, and the places of least hashes in windows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=4)
def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = int(BASES[which])
    inverse = pow(base, -1, 1 << 64)
    up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))])) for b in (base, inverse))
    table = np.random.default_rng(7 + which).integers(1, 1 << 64, 256, np.uint64)
    return up, down, table


def prefix_sums(raw: np.ndarray, which: int, most: int) -> np.ndarray:
    _, down, table = powers(which, most)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * down[: len(raw)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def minima(h: np.ndarray, w: int) -> np.ndarray:
    """The places of the least of every w values in a row, the last of those that agree in 40 bits. There may be 2 ** 24 values."""
    m = len(h)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | (low - np.arange(m, dtype=np.uint64))
    blocks = np.full(-(-m // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:m] = key
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = m - w + 1
    least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
    at = np.unique((low - (least & low)).astype(np.int64))
    # In periodic text many places tie; those are dropped that no window needs.
    if len(at) > 2 and (h[at[1:]] == h[at[:-1]]).any():
        keep, kept = np.ones(len(at), bool), at[0]
        for i in range(1, len(at) - 1):
            if h[at[i]] == h[kept] == h[at[i + 1]] and at[i + 1] - kept <= w:
                keep[i] = False
            else:
                kept = at[i]
        at = at[keep]
    return at
