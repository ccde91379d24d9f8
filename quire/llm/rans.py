"""A range asymmetric numeral coder of token ids, vectorised over interleaved lanes.

One frequency table is shared by all blocks. Symbol i of a block belongs to lane i mod `LANES`; each lane is a coder of
its own (32-bit state, 16-bit renormalisation), and all lanes advance together, one numpy step for LANES symbols. The
words that lanes put out are stored in decoding order. Every `EVERY` steps a checkpoint holds the lane states and the
place in the words, so parts of one block can be decoded in parallel. A block ends with CRC-32s of its coded bytes and
of its ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, EVERY, BITS = 1024, 128, 16
LOW = np.uint64(1 << 16)
MAGIC = b"QRNS1\0"
_HEAD = struct.Struct("<6sIIIII")  # magic, ids, lanes, checkpoints, words, CRC-32 of the ids


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for every symbol that occurs (at most 2**bits do)."""
    total, room = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint32)
    present = counts > 0
    if present.sum() > room:
        raise ValueError(f"{present.sum()} symbols don't fit a table of {room}")
    share = counts.astype(np.float64) * (room / total)
    freq = np.where(present, np.maximum(1, np.floor(share)), 0).astype(np.int64)
    excess = int(freq.sum()) - room
    if excess < 0:  # the rest goes by largest remainder
        order = np.argsort(np.where(present, freq - share, np.inf), kind="stable")[: min(-excess, int(present.sum()))]
        freq[order] += 1
        freq[np.argmax(counts)] += room - int(freq.sum())
    while excess > 0:  # too many raised to 1: take from the largest, never below 1
        order = np.argsort(-freq, kind="stable")
        cut = np.minimum(np.maximum(0, freq[order] - 1), np.maximum(1, freq[order] * excess // room))
        cut = np.where(np.cumsum(cut) <= excess, cut, np.maximum(0, excess - (np.cumsum(cut) - cut)))
        freq[order] -= cut
        excess = int(freq.sum()) - room
    return freq.astype(np.uint32)


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    steps = -(-n // LANES)
    state, words, marks = np.full(LANES, LOW), [], []
    pad = np.concatenate([ids, np.zeros(steps * LANES - n, ids.dtype)]).reshape(steps, LANES)
    live = np.arange(steps * LANES).reshape(steps, LANES) < n
    put = 0
    for t in range(steps - 1, -1, -1):
        some = slice(None) if live[t, -1] else live[t]
        f, c, x = table.freq[pad[t][some]], table.start[pad[t][some]], state[some]
        full = x >= f << LOW_SHIFT
        words.append((x[full] & MASK16).astype(np.uint16))
        put += len(words[-1])
        x = np.where(full, x >> LOW_SHIFT, x)
        q = x // f
        state[some] = (q << LOW_SHIFT) + (x - q * f) + c
        if t % EVERY == 0:
            marks.append((put, state.astype(np.uint32)))
    body = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint16)
    marks = marks[::-1]
    at = np.array([len(body) - p for p, _ in marks], np.uint32)
    states = np.array([s for _, s in marks], np.uint32).reshape(len(marks), LANES)
    head = _HEAD.pack(MAGIC, n, LANES, len(marks), len(body), zlib.crc32(ids.astype("<u4").tobytes()))
    coded = head + at.astype("<u4").tobytes() + states.astype("<u4").tobytes() + body.astype("<u2").tobytes()
    return coded + struct.pack("<I", zlib.crc32(coded))


LOW_SHIFT, MASK16 = np.uint64(16), np.uint64(0xFFFF)


def decode(blob: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """The ids of a block, or of the steps that follow one of its checkpoints; ValueError if a checksum fails."""
    if zlib.crc32(blob[:-4]) != struct.unpack("<I", blob[-4:])[0]:
        raise ValueError("coded bytes are damaged")
    magic, n, lanes, n_marks, n_words, crc = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a block")
    at = np.frombuffer(blob, "<u4", n_marks, _HEAD.size)
    states = np.frombuffer(blob, "<u4", n_marks * lanes, _HEAD.size + 4 * n_marks).reshape(n_marks, lanes)
    body = np.frombuffer(blob, "<u2", n_words, _HEAD.size + 4 * n_marks * (1 + lanes)).astype(np.uint64)
    steps = -(-n // lanes)
    first, last = (0, steps) if part is None else (part * EVERY, min(steps, (part + 1) * EVERY))
    out = np.zeros((last - first, lanes), np.uint32)
    if n_marks:
        state, k = states[first // EVERY].astype(np.uint64), int(at[first // EVERY])
        for t in range(first, last):
            left = n - t * lanes
            some = slice(None) if left >= lanes else slice(0, left)
            x = state[some]
            slot = x & MASK16
            s = table.symbol[slot.astype(np.int64)]
            out[t - first, : len(s)] = s
            x = table.freq[s] * (x >> LOW_SHIFT) + slot - table.start[s]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << LOW_SHIFT) | body[k : k + len(low)]
            k += len(low)
            state[some] = x
    ids = out.ravel()[: min(n, last * lanes) - first * lanes]
    if part is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("decoded ids don't match their checksum")
    return ids
