"""Tries over the words of a block of texts, built with numpy: each node is a run of words, with its count and CRC-32."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from ledgerloom.llm.words import Words

_U32 = np.uint32


@cache
def _zero_bytes() -> np.ndarray:
    """[k, j, v]: what appending 2**k zero bytes makes of a CRC-32 register of which byte j is v and the rest 0."""
    byte = np.array([zlib.crc32(bytes([v]), 0xFFFFFFFF) ^ 0xFFFFFFFF for v in range(256)], _U32)
    own = np.arange(256, dtype=_U32)[None, :] << (8 * np.arange(4, dtype=_U32))[:, None]
    steps = [(own >> _U32(8)) ^ byte[own & _U32(255)]]
    while len(steps) < 32:
        steps.append(_through(steps[-1], steps[-1]))
    return np.array(steps)


def _through(step: np.ndarray, x: np.ndarray) -> np.ndarray:
    return step[0][x & _U32(255)] ^ step[1][(x >> _U32(8)) & _U32(255)] ^ step[2][(x >> _U32(16)) & _U32(255)] ^ step[3][x >> _U32(24)]


def continued(states: np.ndarray, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each text of which states has the CRC, with bytes appended that have these CRCs and lengths of their own."""
    out, steps = states.copy(), _zero_bytes()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        on = (lengths >> k) & 1 == 1
        out[on] = _through(steps[k], out[on])
    return out ^ crcs


def _spelled(words: Words, a: int, b: int) -> tuple[np.ndarray, list[bytes]]:
    """The words a to b - 1 as numbers, and the spelling of each number."""
    start, end = words.start[a:b], words.end[a:b]
    base = start[0]
    lengths = end - start
    steps = np.zeros(end[-1] - base + 1, np.int8)
    steps[start - base] = 1
    steps[end - base] -= 1
    inside = np.cumsum(steps, dtype=np.int8)[:-1].view(bool)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype("<i8")
    data = np.ascontiguousarray(words.bytes[base : end[-1]][inside])
    known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return known.indices.to_numpy().astype(np.int64), known.dictionary.to_pylist()


class Level:
    """Nodes of one depth: crc and count of each, and for each place of the block that starts such a run, its word and its node."""

    def __init__(self, crc: np.ndarray, place: np.ndarray, node: np.ndarray):
        self.crc, self.place, self.node = crc, place, node

    def count(self) -> np.ndarray:
        return np.bincount(self.node, minlength=len(self.crc))


def tries(words: Words, depth: int, block: int = 1 << 18) -> Iterator[Level]:
    """The levels of a trie for each block of words; a run that goes on in the next block counts where it starts.

    A child is told by its node and the next word, and its CRC goes on from its node's: no run is ever spelled out.
    """
    for a in range(0, len(words.start), block):
        b = min(a + block, len(words.start))
        ids, spelling = _spelled(words, a, min(b + depth - 1, len(words.start)))
        after = np.array([zlib.crc32(b" " + w) for w in spelling], _U32)
        length = np.array([len(w) + 1 for w in spelling], np.int64)
        crc, place, node = np.array([zlib.crc32(w) for w in spelling], _U32), np.arange(b - a), ids[: b - a]
        yield Level(crc, place + a, node)
        doc = words.doc[a : a + len(ids)]
        for k in range(1, depth):
            goes_on = place + k < len(ids)
            goes_on[goes_on] = doc[place[goes_on] + k] == doc[place[goes_on]]
            place, node = place[goes_on], node[goes_on]
            if not len(place):
                break
            edges = pa.array(node * len(spelling) + ids[place + k]).dictionary_encode()
            parent, word = np.divmod(edges.dictionary.to_numpy(), len(spelling))
            crc = continued(crc[parent], after[word], length[word])
            node = edges.indices.to_numpy().astype(np.int64)
            yield Level(crc, place + a, node)
