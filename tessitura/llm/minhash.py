"""MinHash signatures of many sets at once, in NumPy."""

from __future__ import annotations

import numpy as np

from tessitura.llm.common import mix

CHUNK = 65_536


def multipliers(k: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) + np.uint64(seed << 20)).astype(np.uint32) | np.uint32(1)


def signatures(hashes: np.ndarray, starts: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """sets x k minima.  ``hashes``: well-mixed 64-bit members; ``starts``: where each non-empty set begins."""
    n = len(starts)
    out = np.empty((k, n), np.uint32)
    a = multipliers(k, seed)
    ends = np.append(starts[1:], len(hashes))
    i = 0
    while i < n:
        j = int(np.searchsorted(ends, starts[i] + CHUNK, side="right"))
        j = max(j, i + 1)
        part = hashes[starts[i] : ends[j - 1]]
        at = starts[i:j] - starts[i]
        low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        x = np.empty_like(low)
        for m in range(k):
            np.multiply(low, a[m], out=x)
            np.add(x, high, out=x)
            out[m, i:j] = np.minimum.reduceat(x, at)
        i = j
    return out.T


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """sets x bands: a 64-bit hash of each band's number and values."""
    n, k = signature.shape
    s = signature.reshape(n, k // rows, rows).astype(np.uint64)
    h = np.broadcast_to(mix(np.arange(1, k // rows + 1, dtype=np.uint64)), (n, k // rows)).copy()
    for r in range(rows):
        h = mix(h ^ (s[:, :, r] + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (2**64 - 1))))
    return h


def odd_sketches(signature: np.ndarray, bits: int) -> np.ndarray:
    """sets x bits/8 bytes: each sample (its number and value) flips one bit of a parity bitmap."""
    n, k = signature.shape
    where = mix(signature.astype(np.uint64) + (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(33))) % np.uint64(bits)
    flips = np.bincount((np.arange(n)[:, None] * bits + where.astype(np.int64)).ravel(), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(flips.astype(np.uint8), axis=1)


def odd_similarity(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Estimated share of equal samples, from the odd sketches (rows) of two lists of sets."""
    bits = x.shape[1] * 8
    odd = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    left = 1 - 2 * odd / bits
    differ = np.where(left > 0, -bits / 2 * np.log(np.maximum(left, 1e-12)), np.inf)
    return 1 - differ / (2 * k)
