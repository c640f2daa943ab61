"""A hash table of whole numbers for arrays of keys, by open addressing."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.int64(-1)


class Slots:
    """Where each key stands in the array of distinct keys, none below zero, that the table was made of."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.places = np.full(1 << bits, _FREE), np.zeros(1 << bits, np.int64)
        keys = keys.astype(np.int64)
        places, at = np.arange(len(keys)), self._first(keys)
        while len(keys):  # of the keys that want a free slot one gets it; the others try the next
            free = self.keys[at] == _FREE
            self.keys[at[free]] = keys[free]
            lost = self.keys[at] != keys
            self.places[at[~lost]] = places[~lost]
            keys, places, at = keys[lost], places[lost], at[lost] + 1 & self.last

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _MIX >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none; a key below zero has none."""
        at = self._first(keys)
        met = self.keys[at]
        hit = (met == keys) & (keys >= 0)
        out = np.where(hit, self.places[at], -1)
        todo = np.flatnonzero(~hit & (met != _FREE))
        at = at[todo]
        while len(todo):
            at = at + 1 & self.last
            met = self.keys[at]
            hit = (met == keys[todo]) & (met != _FREE)
            out[todo[hit]] = self.places[at[hit]]
            go = ~hit & (met != _FREE)
            todo, at = todo[go], at[go]
        return out
