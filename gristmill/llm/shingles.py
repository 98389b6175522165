"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased (A-Z) words, with repeats; fewer words than a shingle: one of all of them."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[: -shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
