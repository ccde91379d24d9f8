"""Page rasters in numpy: openings, components, rules, shading and skew. A page is one row; nothing crosses pages."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators.components import roots

# Fixed values.
RULE_DARK, INK = 185, 160
TILE, PERCENT, FLAT, FLOOR, SLACK, PASSES = 96, 95, 32, 48, 30, 8
MOST_SKEW, LEAST_SKEW, COARSE, FINE = 3.0, 0.15, 0.4, 0.1


def row_runs(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every horizontal run of set pixels."""
    h, w = bits.shape
    wide = np.zeros((h, w + 2), bool)  # rows end unset, so edges come in pairs
    wide[:, 1:-1] = bits
    flat = wide.ravel()
    edge = np.flatnonzero(flat[1:] != flat[:-1])
    y, start = np.divmod(edge[::2], w + 2)
    return y, start, edge[1::2] - y * (w + 2)


def opened(bits: np.ndarray, horizontal: bool, least: int) -> np.ndarray:
    """Only runs of at least a length stay; 0 changes nothing."""
    if least == 0:
        return bits.copy()
    if not horizontal:
        return opened(bits.T, True, least).T
    y, start, end = row_runs(bits)
    keep = end - start >= least
    marks = np.zeros((bits.shape[0], bits.shape[1] + 1), np.int32)
    np.add.at(marks, (y[keep], start[keep]), 1)
    np.add.at(marks, (y[keep], end[keep]), -1)
    return marks.cumsum(1)[:, :-1] > 0


def labelled(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and component of every run; components count from 0 in raster order of their first pixels.

    Runs are the nodes; runs of neighbouring rows that touch, also at a corner, are linked.
    """
    y, start, end = row_runs(bits)
    if not len(y):
        return y, start, end, y
    row = y * (bits.shape[1] + 2)  # runs of a row lie in a stretch of their own
    above = row - (bits.shape[1] + 2)
    lo = np.searchsorted(row + end, above + start, "left")  # ends are exclusive, so a corner touches at equality
    hi = np.searchsorted(row + start, above + end, "right")
    links = [(k, j) for k, (p, q) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)) for j in (k, *range(p, q))]
    root = roots(links)
    return y, start, end, np.unique([root[k] for k in range(len(y))], return_inverse=True)[1]


def blobs(bits: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x, y, width, height and area of each 8-connected component, in raster order of their first pixels."""
    found: dict[int, list[int]] = {}
    for row, s, e, k in zip(*(v.tolist() for v in labelled(bits)), strict=True):
        box = found.setdefault(k, [s, row, e, row + 1, 0])
        box[0], box[2], box[3], box[4] = min(box[0], s), max(box[2], e), row + 1, box[4] + e - s
    return [(a, b, c - a, d - b, n) for _, (a, b, c, d, n) in sorted(found.items())]


def rules(gray: np.ndarray, horizontal: bool, least: int, thick: float) -> list[tuple[float, float, float]]:
    """(from, to, at) of long thin dark bars."""
    out = []
    for x, y, w, h, area in blobs(opened(gray < RULE_DARK, horizontal, least)):
        along, begin, across, width = (w, x, y, h) if horizontal else (h, y, x, w)
        if along >= least and area / along <= thick:
            out.append((float(begin), float(begin + along), across + width / 2))
    return out


def page_rules(gray: np.ndarray) -> tuple[list, list, float]:
    """Horizontal and vertical rules of a page, and the tolerance that goes with its width."""
    h, w = gray.shape
    thick = max(w / 500, 4.0)
    return rules(gray, True, max(w // 40, 40), thick), rules(gray, False, max(h // 120, 10), thick), max(w / 300, 5.0)


def background(gray: np.ndarray) -> np.ndarray:
    """The paper's brightness by tile: a high order statistic of every second pixel, dark holes filled from neighbours."""
    h, w = gray.shape
    out = np.zeros((-(-h // TILE), -(-w // TILE)), np.int32)
    for r in range(out.shape[0]):
        for c in range(out.shape[1]):
            some = np.sort(gray[r * TILE : (r + 1) * TILE : 2, c * TILE : (c + 1) * TILE : 2], axis=None)
            out[r, c] = some[(len(some) - 1) * PERCENT // 100]
    for _ in range(PASSES):
        around = np.lib.stride_tricks.sliding_window_view(np.pad(out, 1), (3, 3)).max((2, 3))
        filled = np.where(around - out > SLACK, around, out)
        if (filled == out).all():
            break
        out = filled
    return np.maximum(out, FLOOR)


def flattened(gray: np.ndarray) -> tuple[np.ndarray, int]:
    """The page with its shading divided out, and the brightness spread; pages that are flat or small stay (0)."""
    h, w = gray.shape
    if min(h, w) < TILE:
        return gray, 0
    paper = background(gray)
    spread = int(paper.max() - paper.min())
    if spread < FLAT:
        return gray, 0

    def places(n: int, tiles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n, dtype=np.float32) + 0.5) / TILE - 0.5
        low = np.maximum(np.floor(at), 0)
        k = low.astype(np.int64)
        return np.minimum(k, tiles - 1), np.minimum(k + 1, tiles - 1), (at - low).astype(np.float32)

    y0, y1, fy = places(h, paper.shape[0])
    x0, x1, fx = places(w, paper.shape[1])
    across = paper[:, x0] + fx * (paper[:, x1] - paper[:, x0])
    light = across[y0] + fy[:, None] * (across[y1] - across[y0])
    return np.clip(gray * 255.0 / np.maximum(light, 1.0), 0, 255).astype(np.uint8), spread


def skew(gray: np.ndarray) -> float:
    """The angle whose row profile is sharpest, coarse then fine; the straight page wins ties."""
    h, w = gray.shape
    if not h or not w:
        return 0.0
    step = max(w // 240, 1)
    y, k = np.nonzero(gray[:, ::step] < INK)
    x = k * step - w / 2

    def sharp(degrees: float) -> float:
        at = y + x * math.tan(math.radians(degrees))
        rows = np.bincount(at[(at >= 0) & (at < h)].astype(np.int64), minlength=h)
        return float((np.diff(rows).astype(np.float64) ** 2).sum())

    def best(lo: float, hi: float, by: float) -> float:
        tried = [0.0, *(lo + by * i for i in range(int((hi - lo) / by + 1e-4) + 1))]
        scores = [sharp(a) for a in tried]
        return tried[int(np.argmax(scores))]

    near = best(-MOST_SKEW, MOST_SKEW, COARSE)
    return best(max(near - COARSE, -MOST_SKEW), min(near + COARSE, MOST_SKEW), FINE)


def rotated(gray: np.ndarray, degrees: float) -> np.ndarray:
    """A gray or colour raster rotated about the centre with bilinear sampling and white corners; tiny angles change nothing."""
    if abs(degrees) < LEAST_SKEW:
        return gray
    if gray.ndim == 3:
        return np.stack([rotated(gray[:, :, c], degrees) for c in range(gray.shape[2])], 2)
    h, w = gray.shape
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    y, x = np.mgrid[0:h, 0:w].astype(np.float32)
    dx, dy = x - w / 2, y - h / 2
    sx, sy = c * dx - s * dy + w / 2, s * dx + c * dy + h / 2
    padded = np.pad(gray, 1, constant_values=255).astype(np.float32)
    px, py = np.clip(sx + 1, 0, w), np.clip(sy + 1, 0, h)
    ix, iy = np.floor(px).astype(np.int64), np.floor(py).astype(np.int64)
    fx, fy = px - ix, py - iy
    top = padded[iy, ix] * (1 - fx) + padded[iy, ix + 1] * fx
    low = padded[iy + 1, ix] * (1 - fx) + padded[iy + 1, ix + 1] * fx
    out = top * (1 - fy) + low * fy
    outside = (sx < -1) | (sx > w) | (sy < -1) | (sy > h)
    return np.where(outside, 255, np.rint(out)).astype(np.uint8)


def straightened(gray: np.ndarray) -> tuple[np.ndarray, float]:
    angle = skew(gray)
    return (gray, 0.0) if abs(angle) < LEAST_SKEW else (rotated(gray, -angle), angle)


def raster(w: int, h: int, px: bytes) -> np.ndarray:
    return np.frombuffer(px, np.uint8).reshape(h, w)


def prepared(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, w, h, px and, if there is colour, rgb) with shading, then skew, taken out.

    Rules and recognition see the same raster; colour is only turned, by the same angle.
    """
    colour = "rgb" in pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a raster at a time
                (r,) = batch.slice(k, 1).to_pylist()
                flat, spread = flattened(raster(r["w"], r["h"], r["px"]))
                straight, angle = straightened(flat)
                row = {**{k: r[k] for k in ("doc_id", "page_no", "w", "h")}, "px": straight.tobytes(), "spread": spread, "angle": float(angle)}
                if colour:
                    row["rgb"] = None if r["rgb"] is None else rotated(np.frombuffer(r["rgb"], np.uint8).reshape(r["h"], r["w"], 3), -angle).tobytes()
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("px", pa.binary()), ("spread", pa.int32()), ("angle", pa.float64()), *([("rgb", pa.binary())] if colour else [])])
    more = ["rgb"] if colour else []
    return pages.select("doc_id", "page_no", "w", "h", "px", *more).mapInArrow(run, "doc_id long, page_no int, w int, h int, px binary, spread int, angle double" + ", rgb binary" * colour)
