"""Baseline JPEG pictures of rasters, in numpy: whole-image transforms, and Huffman codes made for each picture.

No table of codes is built in: lengths come from the picture's own symbol counts, limited to 16 bits. The quantisation
follows the usual quality scale over a table that grows with frequency.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: The luminance quantisation that quality 50 stands for, by row.
QUANT = np.array(
    [[16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62], [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99]]
)
#: Places of an 8 by 8 block along its anti-diagonals, back and forth.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8) if (k // 8 + k % 8) % 2 else (k % 8))))
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
ZRL, EOB = 0xF0, 0x00


def quantisation(quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((QUANT * scale + 50) // 100, 1, 255)


def _blocks(channel: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients in zigzag order, a row for each block; the last row and column of pixels fill whole blocks."""
    h, w = channel.shape
    px = np.pad(channel.astype(np.float32) - 128, ((0, -h % 8), (0, -w % 8)), mode="edge")
    px = px.reshape(px.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    return np.rint(_COS.astype(np.float32) @ px @ _COS.T.astype(np.float32) / table).astype(np.int32).reshape(-1, 64)[:, ZIGZAG]


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _symbols(blocks: np.ndarray, channel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all blocks in order: whether each symbol is a DC one, the symbol, and its extra bits with their number."""
    n = len(blocks)
    dc = blocks[:, 0].copy()
    for c in np.unique(channel):
        own = channel == c
        dc[own] = np.diff(dc[own], prepend=0)
    row, k = np.nonzero(blocks[:, 1:])
    value = blocks[row, k + 1]
    run = k - np.where(np.diff(row, prepend=-1) > 0, -1, np.concatenate([[0], k[:-1]])) - 1
    long = run >> 4
    last = np.full(n, -1)
    last[row] = k  # the last one stands
    ended = np.flatnonzero(last < 62)
    # every symbol with its place: block, then position inside it
    place = [np.stack([np.arange(n), np.full(n, -1), np.zeros(n, int)]), np.stack([np.repeat(row, long), np.repeat(k, long), np.zeros(int(long.sum()), int)]), np.stack([row, k, np.ones(len(row), int)]), np.stack([ended, np.full(len(ended), 64), np.zeros(len(ended), int)])]
    symbol = [_size(dc), np.full(int(long.sum()), ZRL), (run & 15) << 4 | _size(value), np.full(len(ended), EOB)]
    extra = [dc, np.zeros(int(long.sum()), int), value, np.zeros(len(ended), int)]
    is_dc = np.repeat([True, False, False, False], [len(s) for s in symbol])
    symbol, extra = np.concatenate(symbol), np.concatenate(extra)
    order = np.lexsort(np.concatenate(place, 1)[::-1])
    symbol, extra, is_dc = symbol[order], extra[order], is_dc[order]
    bits = np.where(is_dc, symbol, symbol & 15)
    return is_dc, symbol, np.where(extra < 0, extra + (1 << bits) - 1, extra), bits


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at most 16 bits, none of all ones; 0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    heap = [(int(counts[s]), i, [int(s)]) for i, s in enumerate(used)] + [(0, 1 << 20, [-1])]  # -1 takes the code of all ones
    lengths = dict.fromkeys([*used.tolist(), -1], 0)
    heapq.heapify(heap)
    serial = 1 << 21
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for s in left + right:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, serial, left + right))
        serial += 1
    deep = max(lengths.values())
    of = np.bincount(list(lengths.values()), minlength=max(deep, 16) + 1)
    for n in range(deep, 16, -1):  # two of the longest move up, under a shorter one that moves down
        while of[n]:
            k = n - 2
            while not of[k]:
                k -= 1
            of[n] -= 2
            of[n - 1] += 1
            of[k + 1] += 2
            of[k] -= 1
    out = np.zeros(256, np.int64)
    sizes = np.repeat(np.arange(len(of)), of)
    by_count = sorted(used.tolist(), key=lambda s: (-int(counts[s]), s))
    out[by_count] = sizes[: len(by_count)]  # the longest of all is left to -1
    return out


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Codes by symbol, and the table's bytes: how many codes of each length, and their symbols."""
    order = sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s))
    codes, code, before = np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= int(lengths[s]) - before
        before = int(lengths[s])
        codes[s] = code
        code += 1
    return codes, bytes(np.bincount(lengths[lengths > 0], minlength=17)[1:17].tolist()) + bytes(order)


def _packed(values: np.ndarray, bits: np.ndarray) -> bytes:
    """Values of so many bits (up to 32) one after the other, filled up with ones; 0xFF is followed by 0."""
    ends = np.cumsum(bits)
    total = int(ends[-1]) if len(ends) else 0
    out = np.ones(-(-total // 8) * 8, np.uint8)
    starts = ends - bits
    for k in range(int(bits.max()) if len(bits) else 0):
        here = np.flatnonzero(bits > k)
        out[starts[here] + k] = (values[here] >> (bits[here] - 1 - k)) & 1
    data = np.packbits(out)
    full = np.flatnonzero(data == 0xFF)
    return np.insert(data, full + 1, 0).tobytes()


def jpeg(px: np.ndarray, quality: int = 90) -> bytes:
    """A picture of a gray (h, w) or colour (h, w, 3) raster. All channels share one quantisation and one pair of codes."""
    h, w = px.shape[:2]
    table = quantisation(quality)
    if px.ndim == 2:
        channels = [px]
    else:
        r, g, b = np.moveaxis(px.astype(np.float32), 2, 0)
        channels = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    n = len(channels)
    blocks = np.stack([_blocks(c, table) for c in channels], 1).reshape(-1, 64)
    is_dc, symbol, extra, bits = _symbols(blocks, np.arange(len(blocks)) % n)
    values, lengths, tables = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), []
    for kind, own in ((0, is_dc), (1, ~is_dc)):
        size = code_lengths(np.bincount(symbol[own], minlength=256))
        codes, body = _codes(size)
        tables.append(bytes([kind << 4]) + body)
        values[own], lengths[own] = codes[symbol[own]] << bits[own] | extra[own], size[symbol[own]] + bits[own]
    part = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    frame = struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(n))
    scan = bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([0, 63, 0])
    head = part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + part(0xDB, b"\0" + bytes(table.ravel()[ZIGZAG].tolist())) + part(0xC0, frame)
    return b"\xff\xd8" + head + b"".join(part(0xC4, t) for t in tables) + part(0xDA, scan) + _packed(values, lengths) + b"\xff\xd9"


def size_of(blob: bytes) -> tuple[int, int, int]:
    """Width, height and channels of a picture that jpeg() made."""
    at = 2
    while blob[at + 1] != 0xC0:
        at += 2 + struct.unpack(">H", blob[at + 2 : at + 4])[0]
    h, w, n = struct.unpack(">HHB", blob[at + 5 : at + 10])
    return w, h, n
