"""A hash table over whole numpy arrays, for code inside tasks."""

from __future__ import annotations

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Numbers:
    """Numbers (0 and up) of 64-bit keys. Keys are compared whole, so that a number is never that of another key."""

    def __init__(self, keys: np.ndarray | None = None, numbers: np.ndarray | None = None) -> None:
        self._room(10)
        if keys is not None:
            self.add(keys, np.arange(len(keys)) if numbers is None else numbers)

    def _room(self, bits: int) -> None:
        self.shift, self.mask, self.used, self.probes = np.uint64(64 - bits), (1 << bits) - 1, 0, 0
        self.key, self.number = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(31))) * _FACTOR) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Keys that differ from each other and are not in the table yet."""
        if 2 * (self.used + len(keys)) > self.mask:
            held = self.number >= 0
            keys, numbers = np.concatenate([self.key[held], keys]), np.concatenate([self.number[held], numbers])
            self._room(int(4 * len(keys)).bit_length())
        self.used += len(keys)
        probe, todo, home = 0, np.arange(len(keys)), self._home(keys)
        while len(todo):
            at = home[todo] + probe & self.mask
            free = self.number[at] < 0
            place, one = np.unique(at[free], return_index=True)
            won = np.nonzero(free)[0][one]
            self.key[place], self.number[place] = keys[todo[won]], numbers[todo[won]]
            todo = np.delete(todo, won)
            probe += 1
        self.probes = max(self.probes, probe)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it isn't in the table."""
        home = self._home(keys)
        there = self.number[home]
        out = np.where(self.key[home] == keys, there, -1)
        left = np.nonzero((out < 0) & (there >= 0))[0]
        for k in range(1, self.probes):
            if not len(left):
                break
            at = home[left] + k & self.mask
            there = self.number[at]
            hit = (self.key[at] == keys[left]) & (there >= 0)
            out[left[hit]] = there[hit]
            left = left[~hit & (there >= 0)]
        return out
