"""A minimal perfect hash over 64-bit keys: levels of bit arrays, each holding the keys that met no other there."""

from __future__ import annotations

import io

import numpy as np

from ledgerloom.llm.words import mixed

_U = np.uint64


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mixed(keys ^ _U((0xA24BAED4963EE407 * (level + 1)) & ((1 << 64) - 1)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32 bits of each key, independent of its places in the levels."""
    return (_hash(keys, 1000) >> _U(32)).astype(np.uint32)


class MinimalPerfectHash:
    """index(keys) gives each of n known keys its own number below n; other keys get any number, or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for packed in levels:
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.ranks.append(base + ones)
            base += int(ones[-1])

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 1.5) -> MinimalPerfectHash:
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            size = -(-int(len(left) * spread) // 64) * 64 + 64
            at = (_hash(left, len(levels)) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            levels.append(np.packbits(bits, bitorder="little").view(np.uint64))
            left = left[~alone]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, packed in enumerate(self.levels):
            if not len(open_):
                break
            at = (_hash(keys[open_], level) % _U(len(packed) * 64)).astype(np.int64)
            word, bit = packed[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1))).astype(np.int64)
            out[open_[hit]] = (self.ranks[level][at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        out.write(np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes())
        for packed in self.levels:
            out.write(packed.astype("<u8").tobytes())
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> MinimalPerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", n, 8), 8 + 8 * n, []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", int(size), at).astype(np.uint64))
            at += 8 * int(size)
        return cls(levels)
