"""Vectorised words, hashes and windows over the UTF-8 bytes of an Arrow text column.

A block is a run of whole documents whose texts together stay near ``BLOCK_BYTES`` (one longer text is a block of
its own). Words are found and hashed by array operations on the bytes; only
words of more than 16 bytes are hashed one by one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 2 << 20
_U = np.uint64
_LEFT, _RIGHT = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a little-endian lane

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words: everything but ASCII white space.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words: ASCII digits and lower- or upper-case letters, and every byte above 0x7F.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[65:91] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, halves: int = 2) -> list[np.ndarray]:
    """Halves of a 128-bit digest of each byte string data[start:end].

    Up to 16 bytes are two lanes, which three rounds of a Feistel network permute, so that different strings of one length never get equal
    digests; longer strings get xxh3's. No round is linear, so patterns of bytes cannot cancel out. One half is the first of the two.
    """
    size = end - start
    wide = np.concatenate((data, np.zeros(16, np.uint8)))
    at_byte = np.ndarray(len(data) + 9, np.uint64, wide, strides=(1,))
    a = at_byte[start] & _MASK[np.minimum(size, 8)]
    b = np.zeros(len(start), np.uint64)
    more = np.flatnonzero(size > 8)
    b[more] = at_byte[start[more] + 8] & _MASK[np.minimum(size[more] - 8, 8)]
    b ^= mix(a + size.astype(np.uint64) * _LEFT)
    a ^= mix(b + _RIGHT)
    out = [a, b ^ mix(a + _LEFT)] if halves == 2 else [a]
    long = np.flatnonzero(size > 16)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        each = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(start[long].tolist(), end[long].tolist(), strict=True)]), np.uint64).reshape(-1, 2)
        for k, half in enumerate(out):
            half[long] = each[:, k]
    return out


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit xxh3 hash of the items values[start:end] of each span."""
    raw, size = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((start * size).tolist(), (end * size).tolist(), strict=True)), np.uint64, len(start))


def release() -> None:
    """Give freed memory back to the system: Python workers live on, beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


@dataclass
class Block:
    """Words of consecutive documents: word i has bytes data[start[i]:end[i]]; document d has words first[d]:first[d + 1]."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    null: np.ndarray
    _fold: bool

    @property
    def documents(self) -> int:
        return len(self.first) - 1

    def word_document(self) -> np.ndarray:
        return np.repeat(np.arange(self.documents), np.diff(self.first))

    def digests(self, halves: int = 2) -> list[np.ndarray]:
        """Halves of the digest of each word (of its lower-cased A-Z form if the block folds case)."""
        return digests(_LOWER[self.data] if self._fold else self.data, self.start, self.end, halves)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: the first half of its digest."""
        return self.digests(1)[0]


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every run of `width` words inside one document.

    Hashes of runs of 1, 2, 4 ... words are chained by a mixing that is not linear, so patterns of words cannot cancel out.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    run, size, whole, done = hashes, 1, None, 0
    while True:
        if width & size:
            part = run[done : done + n]
            whole = part if whole is None else mix(whole * _LEFT + part * _RIGHT)
            done += size
        if done == width:
            break
        run = mix(run[:-size] * _LEFT + run[size:] * _RIGHT)
        size *= 2
    room = np.repeat(first[1:], np.diff(first))[: len(hashes)]
    at = np.flatnonzero(np.arange(len(hashes)) + width <= room)
    return at, (mix(whole) if width == 1 else whole)[at]


def _cut(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    inside = words[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def blocks(column: pa.Array | pa.ChunkedArray, words: np.ndarray, fold: bool, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's documents in blocks; a null text has no words."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    null = np.asarray(column.is_null())
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
        data, own = raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        yield Block(slice(low, high), data, own, *_cut(data, own, words), null[low:high], fold)
        low = high
