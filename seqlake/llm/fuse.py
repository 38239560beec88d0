"""Binary-fuse filters (Graf and Lemire, "Binary Fuse Filters", 2022): approximate membership of a fixed set of keys."""

from __future__ import annotations

import math

import numpy as np


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))


class FuseFilter:
    """Approximate membership of a fixed set of 64-bit keys in about 9 bits a key; no false negatives."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
        low = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
        third = (first + np.uint64(2 * segment)) ^ (h & low)
        return np.stack([first, second, third]).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(np.asarray(keys).astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 3)))
        for attempt in range(64):
            segments = max(1, math.ceil(n * factor * 1.02**attempt / segment) - 2)
            seed = 0x9E3779B97F4A7C15 * (attempt + 1) & (1 << 64) - 1
            slots, prints = cls._slots(keys, seed, segment, segments)
            size = (segments + 2) * segment
            count, owner, alive, rounds = np.zeros(size, np.int64), np.zeros(size, np.int64), np.ones(n, bool), []
            for s in slots:
                np.add.at(count, s, 1)
                np.add.at(owner, s, np.arange(n))
            while True:
                lone = np.nonzero(count == 1)[0]
                if not len(lone):
                    break
                who, at = np.unique(owner[lone], return_index=True)
                rounds.append((who, lone[at]))
                alive[who] = False
                for s in slots:
                    np.subtract.at(count, s[who], 1)
                    np.subtract.at(owner, s[who], who)
            if alive.any():
                continue
            cells = np.zeros(size, np.uint8)
            for who, at in reversed(rounds):  # a slot's cell makes the three cells' exclusive or the key's print
                mine = slots[:, who]
                cells[at] = 0
                cells[at] = prints[who] ^ cells[mine[0]] ^ cells[mine[1]] ^ cells[mine[2]]
            return cls(seed, segment, segments, cells)
        raise RuntimeError("no filter found")

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.int64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        s, prints = self._slots(np.asarray(keys).astype(np.uint64), self.seed, self.segment, self.segments)
        c = self.cells
        return prints == c[s[0]] ^ c[s[1]] ^ c[s[2]]


    @classmethod
    def load(cls, seed: int, segment: int, segments: int, cells: bytes) -> FuseFilter:
        """From a row of filters_of()."""
        return cls(int(np.int64(seed).astype(np.uint64)), segment, segments, np.frombuffer(cells, np.uint8))
