"""Words, lines and windows of many texts at once, as numpy arrays over one UTF-8 buffer.

Tasks hand an Arrow text column here in pieces of a quarter of a megabyte, so the arrays of a piece stay small however
many rows a partition has. A single text longer than that makes a piece of its own and is still read whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

PIECE_BYTES = 1 << 18

# White space that ends a word, and the bytes that are not part of an alphanumeric word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown when a longer text comes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        while len(cls.up) <= n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(_BASE, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(inverse, k, 1 << 64))])


def limit_batches(spark: SparkSession, size: str = "1m") -> None:
    """Bound Arrow batches by bytes, so that a worker's memory does not depend on the length of texts.

    The JVM holds a batch in vectors and once more as it is sent, outside its heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Hand freed memory back to the system, which C libraries otherwise keep for later."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`step` for mapInArrow with memory given back after it: its Python worker stays with the executor for later tasks."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(stream)
        give_back()

    return batches


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of at most `size` bytes, or one text if that is longer."""
    data, offsets = utf8(column)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


class Words:
    """The words of a piece: `starts`, `ends` (bytes), `doc` (row of each word), `first` (word range of each row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        live = ~gap[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = False, live[:-1]
            after[-1], after[:-1] = False, live[1:]
        self.starts = np.flatnonzero(live & (edge[:-1] | ~before))
        self.ends = np.flatnonzero(live & (edge[1:] | ~after)) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    @cached_property
    def _sums(self) -> np.ndarray:
        _Powers.reach(len(self.data) - 1)  # exactly: a piece of full size would double the tables
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _Powers.up[: len(self.data)], out=sums[1:])
        return sums

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans: equal bytes give equal hashes."""
        return mix((self._sums[ends] - self._sums[starts]) * _Powers.down[starts] + (ends - starts).astype(np.uint64))

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.hash_spans(self.starts, self.ends)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of `width` words of one text."""
        n = len(self.starts) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        h = np.zeros(n, np.uint64)
        for i in range(width):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hashes[i : i + n]
        return at, mix(h[at])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every window of `width` words; a text with fewer words gives them all as one window."""
        at, h = self.windows(width)
        rows = self.doc[at]
        short = np.flatnonzero((self.counts > 0) & (self.counts < width))
        one = self.counts[short].astype(np.uint64)
        for i in range(width - 1):
            word = np.minimum(self.first[short] + i, len(self.hashes) - 1)
            one = np.where(i < self.counts[short], one * np.uint64(0xD6E8FEB86659FD93) + self.hashes[word], one)
        rows, h = np.concatenate([rows, short]), np.concatenate([h, mix(one)])
        return rows, h

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.offsets])


def keyed(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One 64-bit key for each (row, hash)."""
    return mix(h + rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
