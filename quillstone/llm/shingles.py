"""Word shingles of a text as a sorted set of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words a worker remembers the hash of.
REMEMBERED = 150_000


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, worked out once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_known = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's last steps)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingles of `width` words (A-Z lower-cased, ASCII white space between), ascending; a shorter text is one shingle; without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))
    take = min(width, len(h))
    out = np.full(len(h) - take + 1, take, dtype=np.uint64)
    for i in range(take):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - take + 1 + i])
    return np.unique(out)
