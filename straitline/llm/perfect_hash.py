"""A minimal perfect hash over distinct 64-bit keys, in numpy, with stored keys.

Level by level, keys that hit a place of a bit array alone keep it and the others go to the next level (the cascade of
Limasset et al., 2017). A key's slot is the rank of its bit over all levels. A key outside the set would get some slot as
well, so each slot stores its key and a look-up compares: slots of foreign keys are -1, without exception.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 2.0, 64


def mix(keys: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit keys."""
    h = (keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Slots 0 to len(keys) - 1; ``keys`` holds the stored key of each slot."""

    def __init__(self, keys: np.ndarray):
        left, self.sizes, bits = np.asarray(keys, np.uint64), [], []
        while len(left):
            if len(self.sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = (mix(left, len(self.sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            self.sizes.append(size)
            left = left[~alone[at]]
        self.bits = np.concatenate(bits) if bits else np.empty(0, np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits).astype(np.int64))])
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self._slots(np.asarray(keys, np.uint64))] = keys

    def __len__(self) -> int:
        return len(self.keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot of each key, right for those of the set; -1 where no level has a bit."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = mix(keys[open_], level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, at & np.uint64(63)
            row = self.bits[word]
            hit = (row >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(row & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = self.ranks[word[hit]] + below[hit]
            open_, base = open_[~hit], base + size // 64
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys outside the set."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self._slots(keys)
        return np.where((out >= 0) & (self.keys[np.maximum(out, 0)] == keys), out, -1)
