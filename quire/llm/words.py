"""Vectorised word kernels over Arrow string batches.

A text column arrives as one byte buffer with row offsets; words, word hashes and n-gram hashes are
computed over that buffer at once, so no Python loop runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 20


def space_table() -> np.ndarray:
    """Byte classes for words separated by ASCII white space; 0 separates."""
    table = np.arange(256, dtype=np.uint8)
    table[[0x20, 9, 10, 11, 12, 13]] = 0
    table[0] = 255  # NUL belongs to words here; 0xFF never occurs in UTF-8
    return table


def fold_table() -> np.ndarray:
    """Byte classes for words of a-z, 0-9 and non-ASCII after lower-casing A-Z; 0 separates."""
    table = np.zeros(256, np.uint8)
    table[0x30:0x3A] = np.arange(0x30, 0x3A)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


SPACES, FOLDED = space_table(), fold_table()

#: The folded form with separators as spaces, so that bytes.split() yields the words.
FOLD_TO_SPACES = bytes(int(x) or 0x20 for x in FOLDED)

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; the tables grow to the longest chunk seen."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1024)
        back = pow(BASE, -1, 1 << 64)
        tables = []
        for base in (BASE, back):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.cumprod(table, dtype=np.uint64))
        _powers, _inverse = tables
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (fixed constants)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def trim() -> None:
    """Give freed memory back: Python workers outlive tasks, and several share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; its memory stays as it is
        pass


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """The words of a string column: byte bounds, row bounds in words, and word hashes."""

    def __init__(self, column: pa.Array, table: np.ndarray):
        data, self.offsets = raw(column)
        self.raw = data
        self.bytes = table[data]
        is_word = self.bytes != 0
        first, last = is_word.copy(), is_word.copy()
        inner = self.offsets[1:-1]
        if len(data):
            first[1:] &= ~is_word[:-1]
            last[:-1] &= ~is_word[1:]
            at = inner[inner < len(data)]
            first[at] = is_word[at]
            before = inner[inner > 0] - 1
            last[before] = is_word[before]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)  # words before each row, and all
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = powers(len(self.bytes) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)], dtype=np.uint64)])
            return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words inside a row, and the index of each run's first word."""
        h = self.hashes() if hashes is None else hashes
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        left = np.repeat(self.bounds[1:], self.counts) - np.arange(len(h))  # words to the row's end
        at = np.flatnonzero(left >= n)
        return mix(rolled(h, n)[at]), at


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of n neighbours."""
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += h[k : k + m]
    return out


def identity(ids: pa.Array, words: Words) -> np.ndarray:
    """A 64-bit hash of each row's id and text, to tell rows with one id apart."""
    up, down = powers(len(words.raw) + 1)
    a, b = words.offsets[:-1], words.offsets[1:]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((words.raw.astype(np.uint64) + np.uint64(1)) * up[: len(words.raw)], dtype=np.uint64)])
        h = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        return mix(h ^ mix(numbers(ids).view(np.uint64) + np.uint64(0x1234567)))


def numbers(ids: pa.Array) -> np.ndarray:
    """Integer ids as int64; null is the largest and so comes last."""
    return pc.fill_null(ids.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).copy()
