"""Minimal perfect hashing of fixed sets of 128-bit keys, in numpy.

A key is a pair of 64-bit words. Each level has a bit for every place that exactly one of the keys
still open falls on; these keys are placed, the others go on to the next level. The number of a key is
the number of bits set before its own, so n keys get the numbers 0 to n - 1, and the map takes a few bits a
key. Different keys part on some level, as both words enter the place.
"""

from dataclasses import dataclass

import numpy as np

from pressroom.llm.bytewords import mix

# Places of a level for each key that is still open.
ROOM = 1.5
_STEP = 0x9E3779B97F4A7C15


def _places(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * _STEP & (1 << 64) - 1)
    return mix(mix(first + seed) ^ second) % np.uint64(size)


@dataclass
class PerfectHash:
    """Per level the number of places and their bits, packed; and how many keys come before each byte."""

    levels: list[tuple[int, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, first: np.ndarray, second: np.ndarray) -> "PerfectHash":
        """For keys that are all different."""
        levels, before = [], 0
        while len(first):
            size = max(int(len(first) * ROOM), 8)
            at = _places(first, second, len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(cls._level(size, np.packbits(alone), before))
            before += int(alone.sum())
            open_keys = ~alone[at]
            first, second = first[open_keys], second[open_keys]
        return cls(levels)

    @staticmethod
    def _level(size: int, bits: np.ndarray, before: int) -> tuple[int, np.ndarray, np.ndarray]:
        counts = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
        return size, bits, before + np.concatenate(([0], counts[:-1]))

    def numbers(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each key; for keys outside the set any number, or -1."""
        found = np.full(len(first), -1, np.int64)
        left = np.arange(len(first))
        for level, (size, bits, before) in enumerate(self.levels):
            at = _places(first[left], second[left], level, size).astype(np.int64)
            byte, place = bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> (7 - place)) & 1 == 1
            ahead = np.bitwise_count(byte[hit] >> (8 - place[hit].astype(np.int16)).astype(np.uint16))
            found[left[hit]] = before[at[hit] >> 3] + ahead
            left = left[~hit]
        return found

    def to_bytes(self) -> bytes:
        sizes = np.array([size for size, _, _ in self.levels], np.int64)
        return b"".join([np.int64(len(sizes)).tobytes(), sizes.tobytes(), *[bits.tobytes() for _, bits, _ in self.levels]])

    @classmethod
    def from_bytes(cls, data: bytes) -> "PerfectHash":
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        at, before, levels = 8 + 8 * n, 0, []
        for size in sizes.tolist():
            bits = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
            levels.append(cls._level(size, bits, before))
            before += int(np.bitwise_count(bits).sum())
            at += len(bits)
        return cls(levels)
