"""Words and hashed shingle sets of texts, for use inside Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

from sessionscope.llm.memo import Memo

_C = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a permutation of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(Memo):
    """64-bit hashes of words, remembered up to a fixed number of bytes."""

    def __missing__(self, word: bytes) -> int:
        h = self.old.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self.keep(word, h)
        return h


def words(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case (bytes.split and bytes.lower know ASCII only)."""
    return text.lower().split()


def shingle_set(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words the whole sequence is one; without words empty."""
    ws = words(text)
    n = len(ws)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, n)
    width = min(k, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        acc = mix64(acc * _C + h[j : n - width + 1 + j])
    return np.unique(acc)
