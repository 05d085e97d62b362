"""Open-addressing hash table over numpy arrays: 64-bit keys to int64 values, whole arrays at a time."""

from __future__ import annotations

import numpy as np

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)  # a key equal to it is stored as 0xFF..FE


class HashTable:
    """`bits` fixes the slots; callers keep the load under a half (see `room`)."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)
        self.size = 0

    def room(self, more: int) -> bool:
        return 2 * (self.size + more) <= self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        keys = np.where(keys == _EMPTY, _EMPTY - np.uint64(1), keys)
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        open_ = np.flatnonzero((found != keys) & (found != _EMPTY))
        slots = slots[open_]
        while len(open_):
            slots = (slots + 1) & self.mask
            found, want = self.keys[slots], keys[open_]
            hit = found == want
            out[open_[hit]] = self.values[slots[hit]]
            rest = ~hit & (found != _EMPTY)
            open_, slots = open_[rest], slots[rest]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Enter keys that are distinct and not there yet."""
        keys = np.where(keys == _EMPTY, _EMPTY - np.uint64(1), keys)
        self.size += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == _EMPTY
            self.keys[slots[free]] = keys[free]  # of several keys for one slot the last stays
            won = free & (self.keys[slots] == keys)
            self.values[slots[won]] = values[won]
            keys, values, slots = keys[~won], values[~won], (slots[~won] + 1) & self.mask
