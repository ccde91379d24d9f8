"""Figures and stacked fractions of page rasters. A page is one row; nothing crosses pages.

A figure is ink that is neither recognised text nor a long thin rule: stamps, signatures, drawings.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions.patterns import FRACTION
from quire.operators import grids, imaging
from quire.operators.components import roots
from quire.operators.page import Box, Line

# Fixed values; shares of the page's width, height or area.
PAD = 3.0
RULE, RULE_LEAST, RULE_THICK, THICK_LEAST = 0.15, 40, 1 / 150, 8
SPECK, NEAR, LEAST_W, LEAST_H, DENSITY, MOST, MARGIN = 2e-5, 0.02, 0.04, 0.02, 0.02, 0.7, 0.004
BAR, BAR_ROWS, HALO, HALO_ROWS, REACH, LEAST_BAR = 0.6, 5, 0.3, (-4, -3, 3, 4), 0.35, (10, 3)

Rect = tuple[int, int, int, int]


def leftover(gray: np.ndarray, boxes: list[Box]) -> np.ndarray:
    """Ink without the padded text boxes and without long thin rules."""
    h, w = gray.shape
    bits = gray < imaging.INK
    for b in boxes:
        bits[int(max(b.y0 - PAD, 0)) : max(int(b.y1 + PAD), 0), int(max(b.x0 - PAD, 0)) : max(int(b.x1 + PAD), 0)] = False
    least, thin = max(int(w * RULE), RULE_LEAST), max(int(w * RULE_THICK), THICK_LEAST)
    for horizontal in (True, False):
        y, start, end, part = imaging.labelled(imaging.opened(bits, horizontal, least))
        if not len(y):
            continue
        n = part.max() + 1
        wide = np.zeros(n, np.int64)
        left, top = np.full(n, w), np.full(n, h)
        np.maximum.at(wide, part, end)
        np.minimum.at(left, part, start)
        np.minimum.at(top, part, y)
        foot = np.zeros(n, np.int64)
        np.maximum.at(foot, part, y + 1)
        is_rule = np.minimum(wide - left, foot - top) <= thin
        for row, a, b in zip(*(v[is_rule[part]].tolist() for v in (y, start, end)), strict=True):
            bits[row, a:b] = False
    return bits


def clumped(rects: list[Rect], gap: int) -> list[Rect]:
    """Bounding boxes of rectangles less than gap apart, joined until none is near another; the order doesn't matter."""
    while rects:
        at = np.array(rects, np.int64)
        links = []
        for k, (x0, y0, x1, y1) in enumerate(rects):
            rest = at[k:]
            near = (rest[:, 0] < x1 + gap) & (x0 < rest[:, 2] + gap) & (rest[:, 1] < y1 + gap) & (y0 < rest[:, 3] + gap)
            links += [(k, k)] + [(k, k + j) for j in np.flatnonzero(near).tolist()]
        root = roots(links)
        groups: dict[int, list[int]] = {}
        for k in range(len(rects)):
            groups.setdefault(root[k], []).append(k)
        if len(groups) == len(rects):
            break
        rects = [(*at[g, :2].min(0).tolist(), *at[g, 2:].max(0).tolist()) for g in groups.values()]
    return rects


def found(gray: np.ndarray, boxes: list[Box], tables: list[tuple[float, float, float, float]], cfg: Config = Config()) -> list[Rect]:
    """Figures of a page by y0 and x0. tables: x0, y0, x1, y1 of its ruled tables, which hold no figures."""
    h, w = gray.shape
    if not h or not w:
        return []
    bits = leftover(gray, boxes)
    parts = [(x, y, x + a, y + b) for x, y, a, b, area in imaging.blobs(bits) if area >= int(w * h * SPECK)]
    total = np.pad(bits.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ink = [int(total[d, c] - total[b, c] - total[d, a] + total[b, a]) for a, b, c, d in parts]
    margin, out = int(w * MARGIN), []

    def tabled(x0: int, y0: int, x1: int, y1: int) -> bool:
        shared = [max(min(x1, int(c)) - max(x0, int(a)), 0) * max(min(y1, int(d)) - max(y0, int(b)), 0) for a, b, c, d in tables]
        return max(shared, default=0) > 0.5 * max((x1 - x0) * (y1 - y0), 1)

    for x0, y0, x1, y1 in clumped(parts, int(w * NEAR)):
        wide, high = x1 - x0, y1 - y0
        small = wide < w * LEAST_W or high < h * LEAST_H
        whole_page = wide > w * MOST and high > h * MOST
        mine = sum(n for n, (a, b, c, d) in zip(ink, parts, strict=True) if a >= x0 and b >= y0 and c <= x1 and d <= y1)
        in_band = y1 / h < cfg.header_y or y0 / h > cfg.footer_y
        if small or whole_page or in_band or mine < wide * high * DENSITY or tabled(x0, y0, x1, y1):
            continue
        out.append((max(x0 - margin, 0), max(y0 - margin, 0), min(x1 + margin, w), min(y1 + margin, h)))
    return sorted(out, key=lambda r: (r[1], r[0]))


def png(px: np.ndarray) -> bytes:
    """A PNG of a gray (h, w) or colour (h, w, 3) raster."""
    h, w = px.shape[:2]

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, -1)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if px.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def unpng(blob: bytes) -> np.ndarray:
    """The raster of png()."""
    w, h, _, kind = struct.unpack(">IIBB", blob[16:26])
    size = struct.unpack(">I", blob[33:37])[0]
    rows = np.frombuffer(zlib.decompress(blob[41 : 41 + size]), np.uint8).reshape(h, -1)[:, 1:]
    return rows.reshape(h, w, 3) if kind == 2 else rows


FIGURES = "doc_id long, page_no int, figure int, x0 int, y0 int, x1 int, y1 int, png binary"


def figures_of(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per figure, with its crop. pages: doc_id, page_no, w, h, px, boxes (as for grids.raster_grids)."""
    names = [c.split()[0] for c in FIGURES.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 6, pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                gray = imaging.raster(r["w"], r["h"], r["px"])
                boxes = [Box(b["t"], b["x0"], b["y0"], b["x1"], b["y1"]) for b in r["boxes"] or []]
                hs, vs, tol = imaging.page_rules(gray)
                tables = [(g.xs[0], g.ys[0], g.xs[-1], g.ys[-1]) for g in grids.grids_of(hs, vs, boxes, r["w"], tol)] if cfg.grid_tables else []
                rows = [(r["doc_id"], r["page_no"], k, a, b, c, d, png(gray[b:d, a:c])) for k, (a, b, c, d) in enumerate(found(gray, boxes, tables, cfg))]
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.record_batch([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], schema=schema)

    return pages.select("doc_id", "page_no", "w", "h", "px", "boxes").mapInArrow(run, FIGURES)


def alignment(x0: Column, x1: Column, width: Column) -> Column:
    """left, center or right, by the figure's middle."""
    middle = (x0 + x1) / 2 / F.greatest(width, F.lit(1))
    return F.when(middle > 0.62, "right").when(middle < 0.38, "left").otherwise("center")


def interleaved(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """Blocks and figures of each page in reading order: doc_id, page_no, at, kind, number.

    A figure stands before the first block that lies below its top; as blocks aren't always ordered by y0, that is the
    first whose running maximum does. blocks: doc_id, page_no, block, y0; figures: doc_id, page_no, figure, y0.
    """
    both = blocks.selectExpr("doc_id", "page_no", "block AS number", "y0", "'block' AS kind").unionByName(figures.selectExpr("doc_id", "page_no", "figure AS number", "y0", "'figure' AS kind"))
    page = Window.partitionBy("doc_id", "page_no")
    high = F.max(F.when(F.col("kind") == "block", F.col("y0"))).over(page.partitionBy("doc_id", "page_no", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    # a block with the figure's own y0 stays before it
    ranked = both.withColumn("reach", F.coalesce(high, F.col("y0"))).withColumn("last", (F.col("kind") == "figure").cast("int"))
    order = page.orderBy("reach", "last", "number")
    return ranked.select("doc_id", "page_no", (F.row_number().over(order) - 1).alias("at"), "kind", "number")


def barred(gray: np.ndarray, up: Box, low: Box) -> bool:
    """Whether a thin, lonely bar lies between two boxes. Boxes are shares of the page's size."""
    h, w = gray.shape
    pixel = lambda v, size: int(max(v * size + 1e-6, 0))
    x0, x1 = pixel(min(up.x0, low.x0), w), min(pixel(max(up.x1, low.x1), w), w)
    y0, y1 = pixel(up.y1 - REACH * (up.y1 - up.y0), h), min(pixel(low.y0 + REACH * (low.y1 - low.y0), h), h)
    if x1 - x0 < LEAST_BAR[0] or y1 - y0 < LEAST_BAR[1]:
        return False
    cover = (gray[y0:y1, x0:x1] < imaging.INK).mean(1)
    peak = int(cover.argmax())
    if cover[peak] <= BAR or (cover > BAR).sum() > BAR_ROWS:
        return False
    return max((cover[peak + d] for d in HALO_ROWS if 0 <= peak + d < len(cover)), default=0.0) < HALO


def stacked(a: Box, b: Box) -> tuple[Box, Box] | None:
    """The upper and the lower one of two boxes that lie over each other."""
    if min(a.x1, b.x1) - max(a.x0, b.x0) <= 0.5 * min(a.x1 - a.x0, b.x1 - b.x0):
        return None
    up, low = (a, b) if a.y0 < b.y0 else (b, a)
    return (up, low) if low.y0 >= up.y0 + 0.5 * (up.y1 - up.y0) else None


def with_fractions(line: Line, gray: np.ndarray) -> Line:
    """The line with every numerator, bar and denominator as one box, whose text carries three marks."""
    boxes = list(line.boxes)
    while pair := next((p for a, b in itertools.combinations(boxes, 2) if (p := stacked(a, b)) and barred(gray, *p)), None):
        up, low = pair
        whole = Box(f"{FRACTION}{up.t}{FRACTION}{low.t}{FRACTION}", min(up.x0, low.x0), up.y0, max(up.x1, low.x1), low.y1)
        boxes = sorted([b for b in boxes if b is not up and b is not low] + [whole], key=lambda b: b.x0)
    return replace(line, boxes=boxes)
