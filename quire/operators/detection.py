"""Around a text detector, without its model: page sizes, its probability map to quadrilaterals, crops and their batches.

Everything is numpy on one page's arrays, whole matrices at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import imaging

# Fixed values.
MOST_SIDE, LEAST_SIDE, STEP = 2000, 30, 32
PROBABLE, LEAST_SCORE, GROWTH, LEAST_EDGE, MOST_PARTS, LINE_STEP = 0.3, 0.5, 1.6, 3.0, 1000, 10.0
UPRIGHT, BATCH, READ_HIGH, READ_WIDE = 1.5, 6, 48, 320


def _weights(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each new pixel of an axis: the two old ones around its middle, and the share of the second."""
    at = np.maximum((np.arange(to) + 0.5) * n / to - 0.5, 0)
    low = np.floor(at).astype(np.int64)
    return low, np.minimum(low + 1, n - 1), at - low


def resized(gray: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear, one axis after the other."""
    y0, y1, fy = _weights(gray.shape[0], h)
    x0, x1, fx = _weights(gray.shape[1], w)
    px = gray.astype(np.float64)
    across = px[:, x0] * (1 - fx) + px[:, x1] * fx
    return np.floor(across[y0] * (1 - fy)[:, None] + across[y1] * fy[:, None] + 0.5).clip(0, 255).astype(np.uint8)


def fitted(gray: np.ndarray) -> tuple[np.ndarray, float, float]:
    """The page within the detector's sides, in multiples of STEP, and the factors back to its own width and height."""
    h, w = gray.shape
    k = MOST_SIDE / max(h, w) if max(h, w) > MOST_SIDE else LEAST_SIDE / min(h, w) if min(h, w) < LEAST_SIDE else 1.0
    if k == 1.0:
        return gray, 1.0, 1.0
    wide, high = (max(int(v * k / STEP + 0.5) * STEP, STEP) for v in (w, h))
    return resized(gray, wide, high), w / wide, h / high


def dilated(bits: np.ndarray, near: int, far: int) -> np.ndarray:
    """Set where any pixel from `near` before to `far` after is, on both axes: (1, 1) is a 3 by 3 kernel, (0, 1) one of 2 by 2 with its origin at the corner."""
    (h, w), reach = bits.shape, range(near + far + 1)
    padded = np.zeros((h + near + far, w + near + far), bool)
    padded[near : near + h, near : near + w] = bits
    down = reduce(np.logical_or, [padded[k : k + h] for k in reach])
    return reduce(np.logical_or, [down[:, k : k + w] for k in reach])


def _turned(corners: np.ndarray, by: int = 1) -> np.ndarray:
    """The corner after each one; with -1 the one before."""
    return np.concatenate((corners[by:], corners[:by]))


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of integer points, counter-clockwise from the leftmost lowest; points on an edge aren't corners."""
    p = points[np.lexsort((points[:, 1], points[:, 0]))]
    p = p[np.append(True, (p[1:] != p[:-1]).any(1))] if len(p) else p
    if len(p) < 3:
        return p.astype(np.float64)

    def chain(some: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for c in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]):
                out.pop()
            out.append(c)
        return out[:-1]

    there = p.tolist()
    return np.array(chain(there) + chain(there[::-1]), np.float64)


def rectangle(corners: np.ndarray) -> np.ndarray:
    """The smallest rectangle around a convex polygon, which has an edge along one of the polygon's; of equal ones the first."""
    along = _turned(corners) - corners
    length = np.hypot(*along.T)
    along = along[length > 1e-6] / length[length > 1e-6, None]
    if len(corners) < 3 or not len(along):
        (x0, y0), (x1, y1) = corners.min(0), corners.max(0)
        return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    across = along[:, ::-1] * (-1, 1)
    u, v = along @ corners.T, across @ corners.T
    k = int(np.argmin(np.ptp(u, 1) * np.ptp(v, 1)))
    ends = [(u[k].min(), v[k].min()), (u[k].max(), v[k].min()), (u[k].max(), v[k].max()), (u[k].min(), v[k].max())]
    return np.array(ends) @ np.stack([along[k], across[k]])


def ordered(quad: np.ndarray) -> np.ndarray:
    """Corners as upper left, upper right, lower right, lower left."""
    by_x = quad[np.argsort(quad[:, 0], kind="stable")]
    left, right = (side[np.argsort(side[:, 1], kind="stable")] for side in (by_x[:2], by_x[2:]))
    return np.array([left[0], right[0], right[1], left[1]])


def area(polygon: np.ndarray) -> float:
    """Signed; positive if the corners go counter-clockwise where y goes up."""
    (x, y), (after_x, after_y) = polygon.T, _turned(polygon).T
    return float((x * after_y - y * after_x).sum() / 2)


def grown(quad: np.ndarray, ratio: float = GROWTH) -> np.ndarray:
    """The quadrilateral with every side moved out by area * ratio / perimeter."""
    sides = _turned(quad) - quad
    length = np.hypot(*sides.T)
    if length.sum() < 1e-6:
        return quad
    unit = sides / np.maximum(length, 1e-6)[:, None]
    out = unit[:, ::-1] * (1, -1) * np.sign(area(quad) or -1)
    from_ = quad + out * (abs(area(quad)) * ratio / length.sum())
    before, before_unit = _turned(from_, -1), _turned(unit, -1)
    turn = before_unit[:, 0] * unit[:, 1] - before_unit[:, 1] * unit[:, 0]
    gap = from_ - before
    t = (gap[:, 0] * unit[:, 1] - gap[:, 1] * unit[:, 0]) / np.where(np.abs(turn) < 1e-6, 1, turn)
    return np.where(np.abs(turn)[:, None] < 1e-6, quad, before + before_unit * t[:, None])


def score(probability: np.ndarray, quad: np.ndarray) -> float:
    """The mean probability of pixels whose middle lies inside."""
    h, w = probability.shape
    x0, y0 = np.clip(np.floor(quad.min(0)), 0, (w - 1, h - 1)).astype(int)
    x1, y1 = np.clip(np.ceil(quad.max(0)), 0, (w - 1, h - 1)).astype(int)
    x, y = np.arange(x0, x1 + 1) + 0.5, np.arange(y0, y1 + 1)[:, None] + 0.5
    inside = np.zeros((len(y), len(x)), bool)
    for (ax, ay), (bx, by) in zip(quad.tolist(), _turned(quad, -1).tolist(), strict=True):
        if ay != by:  # a lying side crosses no line
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return float(probability[y0 : y1 + 1, x0 : x1 + 1][inside].mean()) if inside.any() else 0.0


def _edges(quad: np.ndarray) -> tuple[float, float]:
    return float(np.hypot(*(quad[1] - quad[0]))), float(np.hypot(*(quad[2] - quad[1])))


def quadrilaterals(probability: np.ndarray, w: int, h: int) -> np.ndarray:
    """Text boxes of a detector's probability map, on a page of w by h, in reading order: an array of four corners each.

    Likely pixels, grown by one to the upper left, fall into parts; of the first MOST_PARTS each gives its smallest
    rectangle, unless it is tiny or unlikely, grown back from the shrunken text that detectors learn.
    """
    rows, starts, ends, part = imaging.labelled(dilated(probability > PROBABLE, 0, 1))
    scale, found = np.array([w / probability.shape[1], h / probability.shape[0]]), []
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1)[:MOST_PARTS] if len(part) else []:
        quad = rectangle(hull(np.concatenate([np.stack([starts[own], rows[own]], 1), np.stack([ends[own] - 1, rows[own]], 1)])))
        if min(_edges(quad)) < LEAST_EDGE or score(probability, quad) < LEAST_SCORE:
            continue
        quad = rectangle(hull(np.floor(grown(ordered(quad)) + 0.5).astype(np.int64)))
        if min(_edges(quad)) < LEAST_EDGE + 2:
            continue
        quad = np.clip(np.floor(ordered(quad) * scale + 0.5), 0, (w, h))
        if np.hypot(*(quad[1] - quad[0])) > LEAST_EDGE and np.hypot(*(quad[3] - quad[0])) > LEAST_EDGE:
            found.append(quad)
    if not found:
        return np.zeros((0, 4, 2))
    quads = np.array(found)
    quads = quads[np.argsort(quads[:, 0, 1], kind="stable")]
    line = np.cumsum(np.diff(quads[:, 0, 1], prepend=quads[0, 0, 1]) >= LINE_STEP)
    return quads[np.lexsort((quads[:, 0, 0], line))]


def cropped(gray: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The quadrilateral pulled straight, as wide and high as its longer sides; the nearest pixel stands in beyond the page's last."""
    side = lambda a, b: float(np.hypot(*(quad[b] - quad[a])))
    w, h = (max(int(max(a, b) + 0.5), 1) for a, b in ((side(0, 1), side(3, 2)), (side(0, 3), side(1, 2))))
    across, down = (np.arange(w) / w)[None, :, None], (np.arange(h) / h)[:, None, None]
    top, foot = quad[0] + (quad[1] - quad[0]) * across, quad[3] + (quad[2] - quad[3]) * across
    x, y = np.moveaxis(top + (foot - top) * down, 2, 0)
    high, wide = gray.shape
    edge = (x < 0) | (y < 0) | (x >= wide - 1) | (y >= high - 1)
    near = gray[np.clip(np.floor(y + 0.5), 0, high - 1).astype(int), np.clip(np.floor(x + 0.5), 0, wide - 1).astype(int)]
    x0, y0 = np.where(edge, 0, np.floor(x)).astype(int), np.where(edge, 0, np.floor(y)).astype(int)
    fx, fy = x - x0, y - y0
    x1, y1 = np.minimum(x0 + 1, wide - 1), np.minimum(y0 + 1, high - 1)
    px = gray.astype(np.float64)
    mixed = (px[y0, x0] * (1 - fx) + px[y0, x1] * fx) * (1 - fy) + (px[y1, x0] * (1 - fx) + px[y1, x1] * fx) * fy
    return np.where(edge, near, np.floor(mixed + 0.5).clip(0, 255)).astype(np.uint8)


def upright(crop: np.ndarray) -> np.ndarray:
    """Crops that stand on end are turned by a quarter, counter-clockwise."""
    return np.rot90(crop) if crop.shape[0] >= UPRIGHT * max(crop.shape[1], 1) else crop


def read_batches(crops: DataFrame, stretch: float = 1.0) -> DataFrame:
    """Which batch of a page each crop is read in, how wide it becomes, and how wide its batch is padded.

    Crops of like shape go together, BATCH at a time. crops: doc_id, page_no, seq, w, h.
    """
    page = Window.partitionBy("doc_id", "page_no")
    ratio = F.lit(stretch) * F.col("w") / F.col("h")
    numbered = crops.withColumn("ratio", ratio).withColumn("batch", F.floor((F.row_number().over(page.orderBy(F.col("w") / F.col("h"), "seq")) - 1) / BATCH).cast("int"))
    widest = F.greatest(F.lit(READ_WIDE / READ_HIGH), F.max("ratio").over(Window.partitionBy("doc_id", "page_no", "batch")))
    padded = F.floor(READ_HIGH * widest).cast("int")
    return numbered.withColumn("padded", padded).withColumn("wide", F.greatest(F.least(F.ceil(READ_HIGH * F.col("ratio")).cast("int"), F.col("padded")), F.lit(1))).drop("ratio")
