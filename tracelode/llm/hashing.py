"""64-bit hashing in numpy shared by the operators on texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[a-z0-9_]+")
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHasher:
    """Hashes of words; those seen are kept, up to a bounded number."""

    def __init__(self, keep: int = 200_000):
        self.keep, self.seen = keep, {}

    def __call__(self, items: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.keep:
            seen.clear()
        out = np.empty(len(items), np.uint64)
        for i, w in enumerate(items):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        return out


def shingles(items: list[str], hasher: WordHasher, width: int) -> np.ndarray:
    """Sorted distinct hashes of the sequences of width words; empty below width words."""
    if len(items) < width:
        return np.empty(0, np.int64)
    h = hasher(items)
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        acc = np.zeros(n, np.uint64)
        for j in range(width):
            acc = mix(acc * P2 + h[j : j + n] + P1)
    return np.unique(acc.view(np.int64))
