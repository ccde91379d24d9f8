"""Geometry as joins, windows and aggregates. Every join carries document and page, so none is a bare band join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import COL_SLACK, MIN_CHARS
from quire.plans.folding import dealt

PAGE = ("doc_id", "page_no")


def usable_pages(chars: DataFrame, least: int = MIN_CHARS, column: str = "c") -> DataFrame:
    """Pages whose text layer has enough visible characters; the column may hold characters or longer texts."""
    n = F.coalesce(F.sum(F.regexp_count(column, F.lit(r"(?U)\S"))), F.lit(0)).cast("long")
    return chars.groupBy(*PAGE).agg(n.alias("visible")).withColumn("usable", F.col("visible") >= least)


def gap_clusters(values: DataFrame, keys: list[str], value: str, tol: float | Column) -> DataFrame:
    """Clusters of sorted values whose neighbours are at most tol apart: number, mean and size."""
    by = Window.partitionBy(*keys).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(by) > tol).cast("int"), F.lit(1))
    return dealt(values, *keys).withColumn("_new", new).withColumn("cluster", F.sum("_new").over(by)).groupBy(*keys, "cluster").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def reading_order(boxes: DataFrame, step: float = 10.0) -> DataFrame:
    """Line numbers by vertical steps between neighbours, and the place in reading order."""
    by = Window.partitionBy(*PAGE).orderBy("y0", "seq")
    numbered = boxes.withColumn("_new", F.coalesce((F.col("y0") - F.lag("y0").over(by) >= step).cast("int"), F.lit(0)))
    numbered = numbered.withColumn("line", F.sum("_new").over(by)).drop("_new")
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("line", "x0", "seq")))


def crossings(h: DataFrame, v: DataFrame, tol: float) -> DataFrame:
    """Pairs of horizontal and vertical segments of a page that meet. h: h_id, x0, x1, y; v: v_id, y0, y1, x."""
    a = h.select(*PAGE, "h_id", F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y").alias("hy"))
    b = v.select(*PAGE, "v_id", F.col("y0").alias("vy0"), F.col("y1").alias("vy1"), F.col("x").alias("vx"))
    return a.join(b, list(PAGE)).filter(F.col("vx").between(F.col("hx0") - tol, F.col("hx1") + tol) & F.col("hy").between(F.col("vy0") - tol, F.col("vy1") + tol)).select(*PAGE, "h_id", "v_id")


def in_boxes(items: DataFrame, boxes: DataFrame, inside: bool = True) -> DataFrame:
    """Items whose centre lies in a box of the page (closed), or, as an anti join, in none. boxes: bx0, by0, bx1, by1."""
    i, b = items.alias("i"), boxes.alias("b")
    same = [F.col(f"i.{c}") == F.col(f"b.{c}") for c in PAGE]
    x, y = (F.col("i.x0") + F.col("i.x1")) / 2, (F.col("i.y0") + F.col("i.y1")) / 2
    return i.join(b, [*same, x.between(F.col("b.bx0"), F.col("b.bx1")), y.between(F.col("b.by0"), F.col("b.by1"))], "left_semi" if inside else "left_anti")


def uncovered(segs: DataFrame, boxes: DataFrame, share: float = 0.8, inset: float = 0.15, vertical: bool = False) -> DataFrame:
    """Segments that no single text box covers for more than share of their length.

    segs: id, x0, x1, y, or, if vertical, id, y0, y1, x. boxes: bx0, bx1, by0, by1.
    """
    begin, end, at, low, high, near, far = ("y0", "y1", "x", "by0", "by1", "bx0", "bx1") if vertical else ("x0", "x1", "y", "bx0", "bx1", "by0", "by1")
    pad = F.greatest(F.lit(inset) * (F.col(far) - F.col(near)), F.lit(2.0))
    hit = segs.join(boxes.select(*PAGE, "bx0", "bx1", "by0", "by1"), list(PAGE)).filter((F.col(at) >= F.col(near) + pad) & (F.col(at) <= F.col(far) - pad))
    cover = (F.least(end, high) - F.greatest(begin, low)) / F.greatest(F.col(end) - F.col(begin), F.lit(1.0))
    covered = hit.groupBy(*PAGE, "id").agg(F.max(cover).alias("cover")).filter(F.col("cover") > share)
    return segs.join(covered, [*PAGE, "id"], "left_anti")


def anchored(v: DataFrame, ys: DataFrame, tol: float) -> DataFrame:
    """Vertical segments that reach at least two of the page's horizontal positions, up to twice tol past their ends. ys: y.

    Rules at nearly one height are one position: the mean of a cluster whose neighbours are at most tol apart.
    """
    positions = gap_clusters(ys.select(*PAGE, "y"), list(PAGE), "y", tol).select(*PAGE, F.col("mean").alias("y"))
    hit = v.join(positions, list(PAGE)).filter(F.col("y").between(F.col("y0") - 2 * tol, F.col("y1") + 2 * tol))
    return hit.groupBy(*PAGE, "v_id").agg(F.count("*").alias("reached")).filter("reached >= 2")


def band(value: Column, edges: Column) -> Column:
    """The last interior edge at or below a value, counted from 0. edges: a sorted array with both borders."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e <= value))


def col_of(x: Column, starts: Column, slack: float = COL_SLACK) -> Column:
    """The last start that x reaches, up to the slack; 0 if it reaches none."""
    return F.greatest(F.lit(0), F.array_max(F.transform(starts, lambda s, i: F.when(x >= s - slack, i).otherwise(0))))


def runs(pixels: DataFrame, keys: list[str], at: str, least: int, stretch: int = 1 << 16) -> DataFrame:
    """One-dimensional opening: runs of consecutive set positions of at least a length.

    Runs are found in stretches of positions, so that a key with most rows is spread; only runs that touch a stretch's
    border, two for each stretch and key at most, meet in one window to be joined.
    """
    part, by = [*keys, "_b"], Window.partitionBy(*keys, "_b").orderBy(at)
    local = pixels.withColumn("_b", F.floor(F.col(at) / stretch)).withColumn("_k", F.col(at) - F.row_number().over(by))
    local = local.groupBy(*part, "_k").agg(F.min(at).alias("start"), F.max(at).alias("end"))
    touches = (F.pmod("start", F.lit(stretch)) == 0) | (F.pmod("end", F.lit(stretch)) == stretch - 1)
    along = Window.partitionBy(*keys).orderBy("start")
    new = F.coalesce((F.col("start") != F.lag("end").over(along) + 1).cast("int"), F.lit(1))
    joined = local.filter(touches).withColumn("_new", new).withColumn("_run", F.sum("_new").over(along)).groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    every = local.filter(~touches).select(*keys, "start", "end").unionByName(joined.select(*keys, "start", "end"))
    return every.withColumn("length", F.col("end") - F.col("start") + 1).filter(F.col("length") >= least).drop("end")


def line_pitch(lines: DataFrame) -> DataFrame:
    """The upper median of steps between lines, of those in (0, 0.08); 0.02 without any."""
    by = Window.partitionBy(*PAGE).orderBy("ry0", "seq")
    steps = lines.withColumn("d", F.col("ry0") - F.lag("ry0").over(by))
    some = F.array_sort(F.collect_list(F.when((F.col("d") > 0) & (F.col("d") < 0.08), F.col("d"))))
    return steps.groupBy(*PAGE).agg(some.alias("d")).select(*PAGE, F.when(F.size("d") > 0, F.get("d", F.floor(F.size("d") / 2).cast("int"))).otherwise(0.02).alias("lead"))


def usual_indent(lines: DataFrame) -> DataFrame:
    """The most frequent content start, in steps of 1/200; of equally frequent ones the smallest."""
    key = F.round(F.col("cx0") * 200).cast("long")
    return lines.groupBy(*PAGE).agg(F.mode(key, True).alias("k")).select(*PAGE, (F.col("k") / 200).alias("base"))


def indent_level(cx0: Column, base: Column, step: float = 0.035, most: int = 15) -> Column:
    return F.least(F.greatest(F.round((cx0 - base) / step), F.lit(0.0)), F.lit(float(most))).cast("int")


def islands(pieces: DataFrame) -> DataFrame:
    """Tables that continue over pages: a piece goes on if the page before has one with as many columns and close starts.

    pieces: doc_id, page_no, starts (array). Each piece is compared with the one before it.
    """
    by = Window.partitionBy("doc_id").orderBy("page_no")
    before = F.lag("starts").over(by)
    close = F.forall(F.zip_with("starts", before, lambda a, b: F.abs(a - b)), lambda d: d < 0.05)
    go_on = (F.col("page_no") == F.lag("page_no").over(by) + 1) & (F.size("starts") == F.size(before)) & close
    return pieces.withColumn("_new", F.coalesce((~go_on).cast("int"), F.lit(1))).withColumn("island", F.sum("_new").over(by)).drop("_new")


def page_labels(pieces: DataFrame) -> DataFrame:
    """The page label of each island."""
    spans = islands(pieces).groupBy("doc_id", "island").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))
    return spans.withColumn("label", F.when(F.col("first_page") == F.col("last_page"), F.format_string("%d", "first_page")).otherwise(F.format_string("%d-%d", "first_page", "last_page")))


def mostly_landscape(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg((F.count_if(F.col("w") > F.col("h")) * 2 > F.count("*")).alias("landscape"))
