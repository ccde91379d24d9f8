"""Pictures decoded bit by bit."""

import struct

import numpy as np
import pytest
from quire.sinks import jpeg


def decoded(blob):
    """A plain baseline decoder: one block after the other."""
    assert blob[:2] == b"\xff\xd8" and blob[-2:] == b"\xff\xd9"
    at, codes, quant = 2, {}, None
    while True:
        mark, size = blob[at + 1], struct.unpack(">H", blob[at + 2 : at + 4])[0]
        body = blob[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            quant = np.zeros(64)
            quant[jpeg.ZIGZAG] = list(body[1:])
        elif mark == 0xC0:
            h, w, n = struct.unpack(">HHB", body[1:6])
        elif mark == 0xC4:
            table, code, k = {}, 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            assert all(code != (1 << length) - 1 for length, code in table)
            codes[body[0] >> 4] = table
        elif mark == 0xDA:
            break
    bits = "".join(f"{x:08b}" for x in blob[at:-2].replace(b"\xff\0", b"\xff"))
    place = 0

    def take(k):
        nonlocal place
        place += k
        return int(bits[place - k : place] or "0", 2) if k else 0

    def symbol(table):
        length, code = 0, 0
        while (length, code) not in table:
            length, code = length + 1, code << 1 | take(1)
        return table[length, code]

    signed = lambda v, k: v if not k or v >> (k - 1) else v - (1 << k) + 1
    out = np.zeros((n, -(-h // 8) * 8, -(-w // 8) * 8))
    dc = [0] * n
    for y in range(0, out.shape[1], 8):
        for x in range(0, out.shape[2], 8):
            for c in range(n):
                zz = np.zeros(64)
                k = symbol(codes[0])
                dc[c] += signed(take(k), k)
                zz[0], i = dc[c], 1
                while i < 64:
                    s = symbol(codes[1])
                    if s == 0:
                        break
                    i += s >> 4
                    if s != 0xF0:
                        zz[i] = signed(take(s & 15), s & 15)
                    i += 1
                block = np.zeros(64)
                block[jpeg.ZIGZAG] = zz
                out[c, y : y + 8, x : x + 8] = jpeg._COS.T @ (block * quant).reshape(8, 8) @ jpeg._COS + 128
    out = out[:, :h, :w]
    if n == 1:
        return out[0]
    y, cb, cr = out[0], out[1] - 128, out[2] - 128
    return np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)


def drawing(h, w, rng):
    y, x = np.mgrid[0:h, 0:w]
    px = 128 + 80 * np.sin(x / 9) * np.cos(y / 13) + rng.normal(0, 4, (h, w))
    px[h // 3 : h // 3 + 4] = 0
    return px.clip(0, 255).astype(np.uint8)


@pytest.mark.parametrize("shape", [(8, 8), (17, 30), (64, 48), (1, 1)])
@pytest.mark.parametrize("quality", [30, 90])
def test_gray(shape, quality):
    px = drawing(*shape, np.random.default_rng(1))
    found = decoded(jpeg.jpeg(px, quality))
    assert found.shape == px.shape and np.abs(found - px).mean() < (12 if quality == 30 else 3)
    assert jpeg.size_of(jpeg.jpeg(px))[:2] == shape[::-1]


def test_colour_and_flat():
    rng = np.random.default_rng(2)
    px = np.stack([drawing(33, 41, rng) for _ in range(3)], 2)
    assert np.abs(decoded(jpeg.jpeg(px, 95)) - px).mean() < 4
    for level in (0, 255):
        flat = np.full((40, 24), level, np.uint8)
        assert np.abs(decoded(jpeg.jpeg(flat)) - flat).max() < 2
        assert len(jpeg.jpeg(flat)) < 250


def test_noise_and_long_codes():
    px = np.random.default_rng(3).integers(0, 256, (80, 80)).astype(np.uint8)
    assert np.abs(decoded(jpeg.jpeg(px, 100)) - px).mean() < 1
    counts = np.zeros(256, np.int64)
    counts[:30] = [2**k for k in range(30)]
    lengths = jpeg.code_lengths(counts)
    assert lengths.max() <= 16 and (lengths[:30] > 0).all() and sum(2.0 ** -lengths[:30]) < 1
