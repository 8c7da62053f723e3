"""Words as 64-bit numbers: runs of ``[^\\x20\\x09-\\x0D]`` with A-Z in lower case."""

from __future__ import annotations

import numpy as np

from quiremill.llm.bpe import Memo

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Texts to arrays of word hashes, with a table of known words of bounded size."""

    def __init__(self, most: int = 200_000):
        import xxhash

        self._known = Memo(xxhash.xxh64_intdigest, most)

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        words = text.encode().lower().split()  # bytes: only A-Z are lower-cased, only ASCII white space splits
        return np.fromiter(map(self._known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled (an invertible finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; of fewer words, one hash of them all."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    total = np.full(n, np.uint64(min(k, len(words))))
    for j in range(min(k, len(words))):
        total = total * _ODD + words[j : j + n]
    return mixed(total)
