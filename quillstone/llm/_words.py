"""Words and rolling hashes of whole texts, shared by the operators on word windows."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words remembered in a worker.
MAX_WORDS = 200_000
#: Lower-cases A-Z and nothing else.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words, each computed once while it is remembered."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.table = np.zeros(1 << 12, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > MAX_WORDS:
            self._clear()
        index = self.index
        found = list(map(index.get, words))
        if None in found:
            fresh = []
            base = len(index)
            for i, n in enumerate(found):
                if n is None:
                    w = words[i]
                    n = index.get(w)
                    if n is None:
                        n = index[w] = base + len(fresh)
                        fresh.append(xxhash.xxh3_64_intdigest(w))
                    found[i] = n
            while len(index) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros(len(self.table), np.uint64)))
            self.table[base : len(index)] = np.array(fresh, np.uint64)
        return self.table[np.array(found, np.int64)]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * MULTIPLIER + hashes[j : j + n]
    return mix(h)
