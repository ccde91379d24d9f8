"""A page from its items and its raster: noise, zones, ruled grids, lines, fractions, blocks and figures, in reading order.

A page is one row from end to end: its items are gathered to it (a page is bounded by its paper), the raster travels
once, and nothing crosses pages. A page that can't be read becomes a row with an error, and the others go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.config import Config
from quire.functions import text as X
from quire.operators import figures, grids, imaging, noise, page
from quire.operators.page import Box

PAGE = ("doc_id", "page_no")
PARA = "struct<text string, rx0 double, cx0 double, rx1 double, ry0 double, center boolean, bullet boolean>"
CELL = "struct<r int, c int, h int, w int, text string, edges array<boolean>>"
FIGURE = "struct<x0 int, y0 int, x1 int, y1 int, png binary>"
BLOCK = f"struct<kind string, y0 double, starts array<double>, rows array<array<string>>, paras array<{PARA}>, cells array<{CELL}>, figure {FIGURE}, indents array<double>, n_lines int>"
PAGES = f"doc_id long, page_no int, w int, h int, n_items int, n_aside int, error string, blocks array<{BLOCK}>"


@dataclass
class Part:
    """A block of a page; y0 in pixels. starts: column starts of a table, column edges of a grid, as shares of the width."""

    kind: str
    y0: float
    starts: list[float] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    paras: list[dict] = field(default_factory=list)
    cells: list[dict] = field(default_factory=list)
    figure: dict | None = None
    indents: list[float] = field(default_factory=list)
    n_lines: int = 0


def text_part(block: page.Block, h: float, cfg: Config) -> Part:
    paras = page.bulleted(page.paragraphs(block.lines, cfg), cfg)
    keep = ("text", "rx0", "cx0", "rx1", "ry0", "center", "bullet")
    return Part("text", block.lines[0].y0 * h, paras=[{k: getattr(p, k) for k in keep} for p in paras], indents=[line.content for line in block.lines], n_lines=len(block.lines))


def table_part(block: page.Block, h: float) -> Part:
    return Part("table", block.lines[0].y0 * h, block.starts, page.table_rows(block.lines, block.starts), n_lines=len(block.lines))


def grid_part(grid: grids.Grid, w: float) -> Part:
    rows = [[""] * (len(grid.xs) - 1) for _ in grid.ys[1:]]
    for cell in grid.cells:
        rows[cell.r][cell.c] = cell.text
    return Part("grid", grid.ys[0], [x / w for x in grid.xs], rows, cells=[asdict(c) | {"edges": list(c.edges)} for c in grid.cells], n_lines=len(rows))


def woven(lines: list[page.Line], ruled: list[grids.Grid], w: float, h: float, cfg: Config) -> list[Part]:
    """Blocks of the lines with the grids between them: a grid stands before the lines that begin below it and below all grids before it."""
    foot = np.maximum.accumulate([g.ys[-1] / h for g in ruled]) if ruled else np.zeros(0)
    after = np.searchsorted(foot, [line.y0 for line in lines], "left")
    out: list[Part] = []
    for k in range(len(ruled) + 1):
        if k:
            out.append(grid_part(ruled[k - 1], w))
        own = [line for line, n in zip(lines, after.tolist(), strict=True) if n == k]
        out += [text_part(b, h, cfg) if b.kind == "text" else table_part(b, h) for b in page.blocks(own, cfg)]
    return out


def with_figures(parts: list[Part], found: list[Part]) -> list[Part]:
    """Figures among the blocks: each before the first block below its top. found: by y0."""
    reach = np.maximum.accumulate([p.y0 for p in parts]) if parts else np.zeros(0)
    places = np.searchsorted(reach, [f.y0 for f in found], "right").tolist()
    order = sorted([(k, 1, n) for n, k in enumerate(range(len(parts)))] + [(k, 0, n) for n, k in enumerate(places)])
    return [parts[n] if kind else found[n] for _, kind, n in order]


def analysed(w: int, h: int, body: list[Box], aside: list[Box], gray: np.ndarray | None, colour: np.ndarray | None, cfg: Config) -> list[Part]:
    """The blocks of one page. Boxes in pixels; without a raster there are no ruled grids, fractions and figures."""
    ruled = []
    if gray is not None and cfg.grid_tables:
        hs, vs, tol = imaging.page_rules(gray)
        ruled = grids.grids_of(hs, vs, body, w, tol)
    middle = np.array([((b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2) for b in body]).reshape(-1, 2)
    free = np.ones(len(body), bool)
    for g in ruled:
        inside = ((middle >= (g.xs[0], g.ys[0])) & (middle <= (g.xs[-1], g.ys[-1]))).all(1)
        grids.filled(g, [body[k] for k in np.flatnonzero(inside)])
        free &= ~inside
    shares = [Box(b.t, b.x0 / w, b.y0 / h, b.x1 / w, b.y1 / h) for b, is_free in zip(body, free.tolist(), strict=True) if is_free]
    lines = page.visual_lines(shares, cfg.line_tol)
    if gray is not None:
        lines = [figures.with_fractions(line, gray) for line in lines]
    parts = woven(lines, ruled, w, h, cfg)
    if gray is None or not cfg.figures:
        return parts
    tables = [(g.xs[0], g.ys[0], g.xs[-1], g.ys[-1]) for g in ruled]
    crop = gray if colour is None else colour
    found = [Part("figure", float(b), figure={"x0": a, "y0": b, "x1": c, "y1": d, "png": figures.png(crop[b:d, a:c])}) for a, b, c, d in figures.found(gray, [*body, *aside], tables, cfg)]
    return with_figures(parts, found)


def page_of(row: dict, cfg: Config) -> dict:
    """One row of PAGES."""
    out = {k: row[k] for k in (*PAGE, "w", "h")} | {"n_items": 0, "n_aside": 0, "error": None, "blocks": []}
    try:
        if row["problem"]:
            raise ValueError(row["problem"])
        w, h = row["w"], row["h"]
        gray = imaging.raster(w, h, row["px"]) if row["px"] is not None else None
        colour = np.frombuffer(row["rgb"], np.uint8).reshape(h, w, 3) if row["rgb"] is not None else None
        zones: dict[str, list[Box]] = {"body": [], "header": [], "footer": []}
        for b in sorted(row["items"] or [], key=lambda b: b["seq"]):
            zones[b["zone"]].append(Box(b["t"], b["x0"], b["y0"], b["x1"], b["y1"]))
        aside = zones["header"] + zones["footer"]
        parts = analysed(w, h, zones["body"], aside, gray, colour, cfg)
        out |= {"n_items": row["n_items"] or 0, "n_aside": len(aside), "blocks": [vars(p) for p in parts]}
    except Exception as e:  # noqa: BLE001: whatever is wrong with one page, the others go on
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def pages_with(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per page, see PAGES; rasters stay where they are. pages: see pages_of(), with boxes, the page's items as an array."""
    given = {"px": "binary", "rgb": "binary", "problem": "string"}
    pages = pages.select(*PAGE, "w", "h", "boxes", *[F.col(c) if c in pages.columns else F.lit(None).cast(kind).alias(c) for c, kind in given.items()])
    w, h = F.greatest("w", F.lit(1)), F.greatest("h", F.lit(1))
    place = ("x0", "y0", "x1", "y1")
    cleaned = F.transform("boxes", lambda b: F.struct(b["seq"].cast("long").alias("seq"), X.clean(b["t"]).alias("t"), *[b[c].cast("double").alias(c) for c in place], b["s"].alias("s")))
    verdict = lambda b: noise.judged(b["t"], b["s"], b["x0"] / w, b["x1"] / w, b["y0"] / h, b["y1"] / h, cfg)
    zoned = F.transform(F.filter(cleaned, lambda b: verdict(b)[0]), lambda b: F.struct(*[b[c].alias(c) for c in ("seq", "t", *place)], verdict(b)[1].alias("zone")))
    rows = pages.withColumns({"items": zoned, "n_items": F.greatest(F.size("boxes"), F.lit(0))}).drop("boxes")
    schema = to_arrow_schema(StructType.fromDDL(PAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a raster at a time
                yield pa.RecordBatch.from_pylist([page_of(row, cfg) for row in batch.slice(k, 1).to_pylist()], schema)

    return rows.mapInArrow(run, PAGES)


def pages_of(items: DataFrame, pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per page, see PAGES. items: doc_id, page_no, seq, t, x0, y0, x1, y1, s, in pixels; those of other pages are left out.

    pages: doc_id, page_no, w, h, and, where there are rasters, px (gray), rgb and problem (why a page couldn't be read).
    Items and rasters meet by page, so rasters move; where a task has both, pages_with() spares that.
    """
    boxes = F.collect_list(F.struct("seq", "t", "x0", "y0", "x1", "y1", "s")).alias("boxes")
    return pages_with(pages.join(items.groupBy(*PAGE).agg(boxes), list(PAGE), "left"), cfg)


def blocks_of(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, block and the block's columns; a page with an error is one row of kind `failed`, one without blocks `empty`."""
    kind = F.when(F.col("error").isNotNull(), "failed").when(F.size("blocks") == 0, "empty")
    each = pages.withColumn("kind_of_page", kind).select(*PAGE, "kind_of_page", F.posexplode_outer("blocks").alias("block", "b")).select(*PAGE, "kind_of_page", "block", "b.*")
    return each.withColumns({"kind": F.coalesce("kind_of_page", "kind"), "block": F.coalesce("block", F.lit(0))}).drop("kind_of_page")


def statistics(pages: DataFrame) -> DataFrame:
    """By page: recognised items, blocks, tables, ruled grids, and items set aside as header or footer."""
    of = lambda kind: F.size(F.filter("blocks", lambda b: b["kind"] == kind))
    return pages.filter("error IS NULL").select(*PAGE, "n_items", F.size("blocks").alias("n_blocks"), of("table").alias("n_tables"), of("grid").alias("n_grids"), "n_aside")


def summary(pages: DataFrame) -> DataFrame:
    """By document: pages read and failed, whether all of it failed, and the errors in page order."""
    errors = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("page_no", "error"))))
    return pages.groupBy("doc_id").agg(F.count_if(F.col("error").isNull()).alias("n_read"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), errors.alias("errors")).withColumn("failed", F.col("n_read") == 0)
