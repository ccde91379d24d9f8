"""Noise filter and zones: rows are items; every rule is a predicate over relative coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions import text as X


def relative(items: DataFrame, width: float | Column, height: float | Column) -> DataFrame:
    return items.withColumns({"rx0": F.col("x0") / width, "rx1": F.col("x1") / width, "ry0": F.col("y0") / height, "ry1": F.col("y1") / height})


def judged(t: Column, s: Column, rx0: Column, rx1: Column, ry0: Column, ry1: Column, cfg: Config = Config()) -> tuple[Column, Column]:
    """Whether an item is kept, and its zone (body, header or footer). t: cleaned text; places as shares of the page."""
    n = F.length(t)
    keep = n > 0
    if cfg.drop_stamp:
        prose = (rx0 <= 0.95) & (rx1 >= 0.05) & X.looks_like_prose(t)
        edge = ((ry1 > 0.90) | (ry0 < 0.05)) & (s < 0.88) & (n <= 3) & ~prose
        side = ((rx0 > 0.95) | (rx1 < 0.05)) & (n <= 3)
        stamp = (s < cfg.stamp_conf) & (n <= 4) & ~prose & ~X.short_label(t)
        keep &= ~(edge | side | stamp)
    header = F.lit(cfg.drop_header) & (ry1 < cfg.header_y) & X.like(t, cfg.header)
    footer = F.lit(cfg.drop_footer) & (ry0 > cfg.footer_y) & X.like(t, cfg.footer)
    return keep, F.when(header, "header").when(footer, "footer").otherwise("body")


def zones(items: DataFrame, width: float | Column, height: float | Column, cfg: Config = Config()) -> DataFrame:
    """Items that are no noise, with cleaned text and zone."""
    rows = relative(items.withColumn("t", X.clean(F.col("t"))), width, height)
    keep, zone = judged(*map(F.col, ("t", "s", "rx0", "rx1", "ry0", "ry1")), cfg)
    return rows.filter(keep).withColumn("zone", zone)
