"""Where each of many numbers stands in a fixed list: a hash table probed by whole arrays."""

from __future__ import annotations

import numpy as np


class LongTable:
    """Positions of non-negative distinct longs; collisions go to the next free slots."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.place = np.full(1 << self.bits, -1, np.int32)
        slots = self._slot(np.asarray(keys, np.int64))
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):
            free = todo[self.keys[slots[todo]] < 0]
            self.keys[slots[free]] = keys[free]  # of several, the last one stays
            self.place[slots[free]] = free
            todo = todo[self.place[slots[todo]] != todo]
            slots[todo] = (slots[todo] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 for one that is not there or negative."""
        at = self._slot(keys)
        found = self.keys[at]
        lost = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes):
            if not len(lost):
                break
            at[lost] = (at[lost] + 1) & self.mask
            found = self.keys[at[lost]]
            lost = lost[(found != keys[lost]) & (found >= 0)]
        return np.where(self.keys[at] == keys, self.place[at], -1)
