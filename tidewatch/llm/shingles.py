"""Five-word shingle sets as sorted arrays of 64-bit hashes.

Words are `[^\\x20\\x09-\\x0D]+` of the text after lower-casing A-Z; a text with
fewer words than a shingle gives its whole word sequence as one shingle, and a
text without words (or a null one) gives the empty set.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE_WORDS = 5
CACHE_WORDS = 150_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection with full avalanche)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Remembers the 64-bit hash of each word seen; forgets all when full."""

    def __init__(self, most: int = CACHE_WORDS) -> None:
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        digest = hashlib.blake2b
        for w in words:
            if w not in known:
                known[w] = int.from_bytes(digest(w, digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes | None, hashes: WordHashes, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct shingles of one text, ascending."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words)
    n = max(len(words) - k + 1, 1)
    acc = np.full(n, min(len(words), k), np.uint64)
    for i in range(min(k, len(words))):
        acc = mix64(acc * _STEP + h[i : i + n])
    # distinct values, ascending
    acc.sort()
    keep = np.ones(n, bool)
    np.not_equal(acc[1:], acc[:-1], out=keep[1:])
    return acc[keep]
