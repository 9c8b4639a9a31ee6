"""Hashes of words, kept for each Python worker."""

from __future__ import annotations

import numpy as np
import xxhash

from cloudloom.llm.common import held

KEPT_WORDS = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    known = held("word hashes", dict)
    if len(known) > KEPT_WORDS:
        known.clear()
    try:
        return np.array([known[w] for w in words], np.uint64)
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)
