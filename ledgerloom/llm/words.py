"""Words of whole texts, found and hashed for many documents at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_U = np.uint64
_powers = [np.ones(1, _U), np.ones(1, _U)]

#: Bytes after A-Z are lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes between white space: all but x20 and x09 to x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of letters and digits: ASCII digits and letters, and every byte of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


def filled(column: pa.Array) -> pa.Array:
    """Nulls as empty texts."""
    return pc.fill_null(column, "") if column.null_count else column


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes of text, or of one longer text."""
    offsets = np.cumsum(np.concatenate(([0], pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))))
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, with the end."""
    wide = column.type in (pa.large_string(), pa.large_binary())
    raw = column.buffers()
    offs = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offs[0] : offs[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """x with its bits spread (a 64-bit finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base of word hashes, and of its inverse."""
    while len(_powers[0]) < n:
        for i, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            old = _powers[i]
            _powers[i] = np.concatenate((old, old * _U(pow(base, len(old), 1 << 64))))
    return _powers[0], _powers[1]


class Words:
    """Words of several texts: doc (row), start and end (bytes from the first text's), first (index of each text's first word)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool = True):
        self.bytes = LOWER[data] if lower else data
        inside = np.concatenate(([False], table[self.bytes], [False]))
        cut = np.zeros(len(data) + 1, bool)  # no word crosses from one text into the next
        cut[offs] = True
        begins = inside[1:] & (~inside[:-1] | cut)
        ends = inside[:-1] & (~inside[1:] | cut)
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)

    def hashes(self, block: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash of each word, equal for equal words: a polynomial over its bytes, from running sums, in blocks of words."""
        out = np.empty(len(self.start), _U)
        at = 0
        while at < len(out):
            base = self.start[at]
            stop = max(at + 1, int(np.searchsorted(self.end, base + block, "right")))
            s, e = self.start[at:stop] - base, self.end[at:stop] - base
            power, inverse = powers(int(e[-1]) + 1)
            sums = np.zeros(int(e[-1]) + 1, _U)
            np.cumsum((self.bytes[base : base + e[-1]].astype(_U) + _U(1)) * power[: e[-1]], out=sums[1:])
            out[at:stop] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U))
            at = stop
        return out


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `size` consecutive words of a text, and the index of each text's first one.

    A text with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    n = np.diff(first)
    total = len(hashes)
    if not total:
        return np.zeros(0, _U), np.zeros(len(first), np.int64)
    rolled = np.zeros(total, _U)
    factor = _U(0xD6E8FEB86659FD93)
    own_end = np.repeat(first[1:], n)
    at = np.arange(total)
    for i in range(size):
        here = np.minimum(at + i, total - 1)
        value = np.where(at + i < own_end, hashes[here], _U(0))
        rolled = rolled * factor + value
    rolled = mixed(rolled + np.minimum(own_end - at, size).astype(_U))
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    keep = at - np.repeat(first[:-1], n) < np.repeat(count, n)
    return rolled[keep], np.concatenate(([0], np.cumsum(count)))
