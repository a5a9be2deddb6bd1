"""Distinct five-word shingles as 64-bit hashes, in numpy.

Words are hashed once per task and combined by a rolling polynomial over the whole chunk. Two different shingles of one
corpus collide with a chance of about n^2 / 2^65; everything else built on these sets is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from .common import Remembered, slices, words

SIZE = 5
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes() -> Remembered:
    """Hashes of words; a task keeps one of these from batch to batch."""
    return Remembered(xxhash.xxh3_64_intdigest)


def shingle_sets(texts: list, hashes: Remembered | None = None) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than SIZE make one shingle, none make none."""
    hashes = word_hashes() if hashes is None else hashes
    for a, b in slices(texts):
        tokens = [words(t) for t in texts[a:b]]
        flat = np.array([hashes[w] for ws in tokens for w in ws], dtype=np.uint64)
        roll = np.zeros(max(len(flat) - SIZE + 1, 0), dtype=np.uint64)
        for i in range(SIZE):
            roll = roll * _MULT + flat[i : i + len(roll)]
        roll = _mix(roll)
        at = 0
        for ws in tokens:
            n = len(ws)
            if n >= SIZE:
                yield np.unique(roll[at : at + n - SIZE + 1])
            elif n:
                h = np.uint64(n)
                with np.errstate(over="ignore"):
                    for w in flat[at : at + n]:
                        h = h * _MULT + w
                yield _mix(np.array([h], dtype=np.uint64))
            else:
                yield np.empty(0, np.uint64)
            at += n
