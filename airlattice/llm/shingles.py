"""Word shingles of a text as 64-bit hashes, and their minima under many hash functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from airlattice.llm.common import words

_STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1024


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; shorter texts are one shingle, wordless ones none."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(k, len(h))
    n = len(h) - k + 1
    a = np.full(n, k, np.uint64)
    for i in range(k):
        a = (a ^ (a >> np.uint64(32))) * _STEP + h[i:i + n]
    a ^= a >> np.uint64(31)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(29)
    return np.unique(a)


@lru_cache(maxsize=8)
def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1),
            rng.integers(0, 1 << 32, count, dtype=np.uint32))


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """The smallest value of a set under each of ``count`` hash functions (32 bits)."""
    a, b = _family(count)
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), CHUNK):
        low = np.minimum(low, (x[at:at + CHUNK, None] * a + b).min(0))
    return low


def shingle_minima(text: str | None, count: int, k: int = 4) -> list[int]:
    s = shingles(text, k)
    return minima(s, count).tolist() if len(s) else []
