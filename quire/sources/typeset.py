"""Deterministic typesetting of the tables into layout records, on pages of 1024 by 2048 pixels.

Powers of two keep relative coordinates exact. A page has 40 rows; row i spans 320 + 32 i to 344 + 32 i.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import textlayer

WIDTH, HEIGHT, ROWS, TOP, PITCH, TALL = 1024, 2048, 40, 320, 32, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(docs: DataFrame) -> DataFrame:
    """doc_id, pos, t: texts in pieces of at most 80 characters that don't cross lines."""
    cut = lambda line: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.length(line) - 1) / 80).cast("int"))), lambda k: F.substr(line, k * 80 + 1, F.lit(80)))
    return docs.select("doc_id", F.posexplode(F.flatten(F.transform(F.split("text", "\n"), cut))).alias("pos", "t"))


def prose(docs: DataFrame) -> DataFrame:
    """Items of prose: a piece a row, indented by position, ten pixels a character."""
    x0 = 64 + 32 * F.pmod(F.col("pos"), F.lit(3))
    y0 = TOP + PITCH * F.pmod(F.col("pos"), F.lit(ROWS))
    return pieces(docs).filter("t != ''").select(
        "doc_id", (F.floor(F.col("pos") / ROWS) + 1).cast("int").alias("page_no"), F.col("pos").alias("seq"), "t",
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 10 * F.length("t")).cast("double").alias("x1"), (y0 + TALL).cast("double").alias("y1"), F.lit(0.99).alias("s"),
    )


#: Fixed values of this adapter: texts that stand in margins, stamps and lists.
STRAYS = ("7", "3 / 96", "-1-", "期。", "• 材料", "u4", "1.公司", "Page 3/9")


def strewn(docs: DataFrame) -> DataFrame:
    """Items all over the page with strays between the prose, and confidences in steps of 1/64."""
    pos = F.col("pos")
    kind = F.pmod(pos + F.col("doc_id"), F.lit(17)).cast("int")
    t = F.when(kind < len(STRAYS), F.element_at(F.array(*map(F.lit, STRAYS)), F.least(kind, F.lit(len(STRAYS) - 1)) + 1)).otherwise(F.col("t"))
    x0 = F.when(F.pmod(pos, F.lit(13)) == 0, 992).otherwise(128)
    y0 = 48 * F.pmod(pos, F.lit(42))
    return pieces(docs).select(
        "doc_id", (F.floor(pos / 42) + 1).cast("int").alias("page_no"), pos.alias("seq"), t.alias("t"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
        (x0 + F.least(F.lit(10) * F.length(t), F.lit(1020) - x0)).cast("double").alias("x1"), (y0 + TALL).cast("double").alias("y1"), (1 - F.pmod(pos, F.lit(24)) / F.lit(64.0)).alias("s"),
    )


#: Fixed values of this adapter: beginnings and ends of an essay's lines; most lines have none.
ESSAY_HEADS = ("", "", "1. ", "", "", "a. ", "", "• ", "", "第二条 ", "", "(1) ", "", "一、", "", "- ")
ESSAY_TAILS = ("", "", "", ".", "", "；")


def essay(docs: DataFrame) -> DataFrame:
    """Items of prose with lists, centred short lines and small indents, ten pixels a character."""
    pos, n = F.col("pos"), F.col("doc_id")
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(k, F.lit(len(xs))) + 1).cast("int"))
    short = F.pmod(pos, F.lit(23)) == 7
    t = F.when(short, F.substring("t", 1, 20)).otherwise(F.concat(pick(ESSAY_HEADS, F.floor(pos / 3) + n), F.col("t"), pick(ESSAY_TAILS, F.floor(pos / 2) + 3 * n)))
    x0 = F.when(short, 412).when(F.pmod(pos, F.lit(11)) == 5, 104).when(F.pmod(pos, F.lit(7)) == 0, 84).otherwise(64)
    y0 = TOP + PITCH * F.pmod(pos, F.lit(ROWS))
    lines = pieces(docs).filter("t != ''").select("doc_id", (F.floor(pos / ROWS) + 1).cast("int").alias("page_no"), pos.alias("seq"), t.alias("t"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"))
    return lines.select("*", (F.col("x0") + 10 * F.length("t")).alias("x1"), (F.col("y0") + TALL).alias("y1"), F.lit(0.99).alias("s"))


def cells(rows: DataFrame, doc: Column, number: Column, columns: list[Column], pitch: int) -> DataFrame:
    """Items of a table: a cell an item, columns pitch pixels apart. number: the row's place in its document, from 0."""
    numbered = rows.select(doc.cast("long").alias("doc_id"), number.cast("long").alias("n"), F.posexplode(F.array(*[c.cast("string") for c in columns])).alias("c", "t"))
    y0 = TOP + PITCH * F.pmod(F.col("n"), F.lit(ROWS))
    x0 = 64 + pitch * F.col("c")
    return numbered.filter("t != ''").select(
        "doc_id", (F.floor(F.col("n") / ROWS) + 1).cast("int").alias("page_no"), (F.col("n") * len(columns) + F.col("c")).alias("seq"), "t",
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + F.least(F.lit(8) * F.length("t"), F.lit(pitch - 40))).cast("double").alias("x1"), (y0 + TALL).cast("double").alias("y1"), F.lit(0.99).alias("s"),
    )


def characters(items: DataFrame, size: float = 10.0) -> DataFrame:
    """One row per character of the items; spaces open gaps and are not drawn themselves."""
    each = items.select("doc_id", "page_no", "seq", "x0", "y0", "y1", F.posexplode(F.split("t", "")).alias("k", "c")).filter("c != ''")
    return each.select("doc_id", "page_no", (F.col("seq") * 1000 + F.col("k")).alias("seq"), "c", (F.col("x0") + 10 * F.col("k")).alias("x0"), "y0", (F.col("x0") + 10 * F.col("k") + 10).alias("x1"), "y1", F.lit(size).alias("size"))


def character_pages(items: DataFrame, size: float = 10.0) -> DataFrame:
    """One row per page of the items, with its characters as an array."""
    each = F.transform(F.filter(F.split("t", ""), lambda c: c != ""), lambda c, k: F.struct(c.alias("c"), (F.col("x0") + 10 * k).alias("x0"), F.col("y0").alias("y0"), (F.col("x0") + 10 * k + 10).alias("x1"), F.col("y1").alias("y1"), F.lit(size).alias("size")))
    lines = items.select("doc_id", "page_no", "seq", each.alias("chars"))
    return lines.groupBy("doc_id", "page_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chars"))), lambda s: s["chars"])).alias("chars"))


def packed_characters(items: DataFrame, size: float = 10.0) -> DataFrame:
    """The characters of the items, packed by page as a reader in Python would hand them over (textlayer.PACKED)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            each = {c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in ("doc_id", "page_no", "seq", "x0", "y0", "y1")}
            x0 = each["x0"] + 10.0 * k
            columns = {"doc_id": each["doc_id"], "page_no": each["page_no"], "seq": each["seq"] * 1000 + k, "c": pa.array(list("".join(texts)), pa.string()), "x0": x0, "y0": each["y0"], "x1": x0 + 10, "y1": each["y1"], "size": np.full(len(k), size)}
            yield textlayer.packed(pa.table(columns))

    return items.select("doc_id", "page_no", "seq", "t", "x0", "y0", "y1").mapInArrow(run, textlayer.PACKED)
