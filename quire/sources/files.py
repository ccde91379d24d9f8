"""File sources and the cache of read items."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pdf_files(spark: SparkSession, folder: str, depth: int = 6, most: int | None = 5000) -> DataFrame:
    """Visible PDF files of a folder down to a depth: path, stem, content. The first `most` by path, or all (None).

    Paths are chosen from the listing; only the chosen files' contents are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.regexp_replace("path", f"^.*?{re.escape(folder.rstrip('/').rsplit('/', 1)[-1])}/", "")
    wanted = F.lower("path").endswith(".pdf") & ~below.rlike(r"(^|/)\.") & (F.size(F.split(below, "/")) <= depth + 1)
    rows = found.filter(wanted)
    if most is not None:
        rows = rows.join(rows.select("path").orderBy("path").limit(most), "path", "left_semi")
    return rows.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "content")


def added(paths: DataFrame, queued: DataFrame) -> DataFrame:
    """Paths that aren't queued yet, each once."""
    return paths.select("path").distinct().join(queued.select("path"), "path", "left_anti")


def missing_pages(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages that the cache doesn't hold under their key; only these need the expensive reader."""
    return pages.join(cache.select("key", "page_no").distinct(), ["key", "page_no"], "left_anti")


#: Columns of an item in the cache, as JSON has them.
ITEM = "struct<t string, x0 double, y0 double, x1 double, y1 double, s double>"


def as_json(items: DataFrame) -> DataFrame:
    """key, page_no, json: the items of each page in order, as one JSON array, to be kept under their key."""
    each = F.struct("seq", F.struct("t", "x0", "y0", "x1", "y1", "s").alias("item"))
    return items.groupBy("key", "page_no").agg(F.to_json(F.transform(F.array_sort(F.collect_list(each)), lambda e: e["item"])).alias("json"))


def from_json(cache: DataFrame) -> DataFrame:
    """Items of cached pages. A damaged entry gives none, as if the page weren't cached."""
    parsed = cache.select("key", "page_no", F.from_json("json", f"array<{ITEM}>", {"mode": "PERMISSIVE"}).alias("items"))
    return parsed.select("key", "page_no", F.posexplode("items").alias("seq", "i")).select("key", "page_no", "seq", "i.*").filter("t IS NOT NULL")


def vacant(wanted: DataFrame, taken: DataFrame, stamp: str) -> DataFrame:
    """path, out: a name for each wanted path that isn't taken: its own, with the time stamp, or with that and a number from 2.

    wanted: path, each once; taken: path. A path has at most one candidate more than taken names begin like it.
    """
    stem, end = F.regexp_extract("path", r"^(.*?)(\.[^./]+)?$", 1), F.regexp_extract("path", r"^(.*?)(\.[^./]+)?$", 2)
    named = wanted.select("path", stem.alias("stem"), end.alias("end"))
    held = taken.select(F.col("path").alias("out")).distinct()
    like = named.join(held.withColumn("stem", F.regexp_extract("out", rf"^(.*?)(-{re.escape(stamp)}(-\d+)?)?(\.[^./]+)?$", 1)), "stem", "left").groupBy("path").agg(F.count("out").alias("n"))
    tries = named.join(like, "path").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") + 1)))
    mark = F.when(F.col("k") == 0, "").when(F.col("k") == 1, f"-{stamp}").otherwise(F.concat(F.lit(f"-{stamp}-"), F.col("k").cast("string")))
    free = tries.withColumn("out", F.concat("stem", mark, "end")).join(held, "out", "left_anti")
    return free.groupBy("path").agg(F.min_by("out", "k").alias("out"))


def chosen_source(pages: DataFrame, layer: DataFrame, read: DataFrame) -> DataFrame:
    """Items of each page from its text layer where that is usable, else from the reader. pages: doc_id, page_no, usable."""
    keys = ["doc_id", "page_no"]
    return layer.join(pages.filter("usable").select(*keys), keys, "left_semi").unionByName(read.join(pages.filter("not usable").select(*keys), keys, "left_semi"))
