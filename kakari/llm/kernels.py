"""Vectorised text kernels shared by the Arrow stages of this subpackage.

A kernel takes a whole Arrow string column and works on its UTF-8 buffer with numpy, so no Python code runs per row or
per word. Null texts count as empty ones. A word is a maximal run of ASCII letters, digits and bytes above 127 of the
lower-cased text; everything else separates words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_WORD[128:] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of x + seed; x is left as it is."""
    with np.errstate(over="ignore"):
        z = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z ^= z >> U(30)
        z *= U(0xBF58476D1CE4E5B9)
        z ^= z >> U(27)
        z *= U(0x94D049BB133111EB)
        z ^= z >> U(31)
    return z


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, U)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.cumprod(p, dtype=U)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets into them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    off = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text column of each has about limit bytes at most (a longer text stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """hash: of each word; start, end: its bytes in data; offsets: the words of each text; data, at: the lower-cased bytes."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    at: np.ndarray


def words(col: pa.Array) -> Words:
    data, at = flat(pc.utf8_lower(col))
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
    return Words(h, start, end, np.searchsorted(start, at), data, at)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, the texts' offsets into them, and the first word of each.

    A text of 1 to k-1 words has one shingle of all its words; a text without words has none.
    """
    n = np.diff(w.offsets)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(offsets[-1]) + np.repeat(w.offsets[:-1] - offsets[:-1], count)
    stop = np.repeat(w.offsets[1:], count)
    total = np.zeros(len(first), U)
    with np.errstate(over="ignore"):
        for j in range(k):
            at = first + j
            part = w.hash[np.minimum(at, len(w.hash) - 1)] if len(w.hash) else total
            total = total * U(0xD6E8FEB86659FD93) + np.where(at < stop, part, U(0))
    return mix(total), offsets, first


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each element, the text it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


class Table:
    """An open-addressing map of distinct 64-bit keys to row numbers, looked up a whole array at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys, self.rows = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = todo[free]
            won = free & (self.rows[slot] == todo)
            self.keys[slot[won]] = keys[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is absent."""
        slot = self._slot(keys)
        out = self.rows[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.rows[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return out


def gram_keys(col: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, it and the length-1 bytes before it in one integer (it is the lowest), and the offsets.

    Before a text stand bytes 255, which UTF-8 never holds.
    """
    data, at = flat(col)
    pad = length - 1
    size = np.diff(at)
    buf = np.full(len(data) + pad * len(size), 255, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(1, len(size) + 1) * pad, size)
    buf[place] = data
    key = np.zeros(len(buf), U)
    wide = buf.astype(U)
    for j in range(length):
        key[j:] |= wide[: len(buf) - j] << U(8 * j)
    return key[place], at


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]]."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]
