"""Looks of paragraphs and tables in word-processor output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions import text as X

# Fixed values.
SUBHEAD_END, SUBHEAD_LENGTH, CENTER_SIZE, HEAD_SIZE = 0.58, 60, 13.0, 12.0
CM = 567.0  # twentieths of a point
LEAST_CELL, LEAST_GRID_CELL = 1.2 * CM, 0.5 * CM


def styled(paras: DataFrame, cfg: Config = Config(), run: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """Paragraphs with style, body, size, bold, align and left (indent levels).

    paras: text, rx1, center, bullet, level and right (see crosspage.indented) and para, the order within a run of text.
    The first that holds: bullet glyph, bullet, right-aligned, heading, sub-heading before a full line, centred, plain.
    """
    t, lead = F.col("text"), F.lead("rx1").over(Window.partitionBy(*run).orderBy("para"))
    sub = (F.col("rx1") < SUBHEAD_END) & ~X.end_punct(t) & (F.length(t) < SUBHEAD_LENGTH) & ~X.num_start(t) & F.coalesce(lead > cfg.full_line, F.lit(False))
    heading = X.heading_level(t)
    glyph = X.bullet(t)
    style = F.when(glyph, "glyph").when(F.col("bullet"), "bullet").when(F.col("right"), "right").when(heading.isNotNull(), "heading").when(sub, "subheading").when(F.col("center"), "center").otherwise("plain")
    s = F.col("style")
    return paras.withColumn("style", style).withColumns({
        "body": F.when(s == "glyph", F.regexp_replace(t, r"(?U)^([•·●○\*]\s*|[-–—]\s+)", "")).otherwise(t),
        "size": F.when(s == "heading", HEAD_SIZE - heading).when(s == "center", CENTER_SIZE).otherwise(cfg.font_size),
        "bold": s.isin("heading", "subheading", "center"),
        "align": F.when(s.isin("right", "center"), s).otherwise("left"),
        "left": F.when(s.isin("right", "subheading", "center"), 0).otherwise(F.col("level")),
    })


def _shares(steps: Column, usable: float, least: float) -> Column:
    total = F.greatest(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x), F.lit(1e-6))
    return F.transform(steps, lambda s: F.round(F.greatest(s * usable / total, F.lit(least))).cast("int"))


def table_widths(starts: Column, usable: float) -> Column:
    """Column widths of a table without rules, from its column starts; the last column reaches the page's side."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.lit(1.0)))
    return _shares(F.zip_with(ends, starts, lambda b, a: b - a), usable, LEAST_CELL)


def grid_widths(edges: Column, usable: float) -> Column:
    """Column widths of a ruled table, from its column edges."""
    ends = F.slice(edges, 2, F.greatest(F.size(edges) - 1, F.lit(0)))
    return _shares(F.zip_with(ends, F.slice(edges, 1, F.size(ends)), lambda b, a: b - a), usable, LEAST_GRID_CELL)
