"""Word shingles and SimHash fingerprints of texts."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 4
SEED = 42


def hashed(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    view, starts = memoryview(joined), [0, *[e + 1 for e in ends]]
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)), np.uint64, len(words) - size + 1)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of one text, unsigned; shingles count as often as they occur."""
    return simhash(hashed(text, size))
