"""The conversion queue as tables: what is added, which formats a batch makes, what is tried again, how far it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def addition(paths: DataFrame, queued: DataFrame) -> DataFrame:
    """One row: how many paths are added, are there twice or already queued (dup), or are no PDF files (skipped)."""
    times = paths.groupBy("path").agg(F.count("*").alias("times"))
    held = queued.select("path", F.lit(True).alias("held")).distinct()
    pdf = F.lower("path").endswith(".pdf")
    known = times.join(held, "path", "left").withColumn("fresh", pdf & F.col("held").isNull())
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return known.agg(
        total(F.col("fresh").cast("int")).alias("added"),
        total(F.when(pdf, F.col("times") - F.col("fresh").cast("int")).otherwise(0)).alias("dup"),
        total(F.when(~pdf, F.col("times")).otherwise(0)).alias("skipped"),
    )


def batch(jobs: DataFrame, default: str, failed_only: bool = False) -> DataFrame:
    """Jobs of a batch, each with its own formats or the default at the start. failed_only tries failed ones again."""
    wanted = jobs.filter("status = 'failed'") if failed_only else jobs
    return wanted.withColumn("formats", F.coalesce("formats", F.lit(default)))


def removed(jobs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The queue without a path, and what was taken out, for undone()."""
    return jobs.filter(F.col("path") != path), jobs.filter(F.col("path") == path)


def undone(jobs: DataFrame, taken: DataFrame) -> DataFrame:
    """The queue with the last removal back, unless the path was added again meanwhile."""
    return jobs.unionByName(taken.join(jobs.select("path"), "path", "left_anti"))


def retried(jobs: DataFrame, path: str) -> DataFrame:
    """The queue with one failed job waiting again; all other results stay."""
    again = (F.col("path") == path) & (F.col("status") == "failed")
    return jobs.withColumn("status", F.when(again, "waiting").otherwise(F.col("status")))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row: files done, failed and left, and failed pages. outcomes: path, status (done, failed or waiting), n_errors."""
    count = lambda s: F.count_if(F.col("status") == s)
    pages = F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("n_errors"))), F.lit(0)).cast("long")
    return outcomes.agg(count("done").alias("done"), count("failed").alias("failed"), count("waiting").alias("left"), pages.alias("failed_pages"))


def toggled(formats: Column, name: Column) -> Column:
    """An array of formats with one switched; the last one can't be switched off."""
    after = F.when(F.array_contains(formats, name), F.array_remove(formats, name)).otherwise(F.array_append(formats, name))
    return F.when(F.size(after) == 0, formats).otherwise(after)


def progress(done: Column, jobs: Column, page: Column, pages: Column, elapsed: Column) -> tuple[Column, Column]:
    """The share of a batch that is done, and the seconds that are left: unknown (null) up to a share of 0.05."""
    inner = F.when(pages > 0, page / pages).otherwise(F.lit(0.0))
    share = F.greatest(F.least((done + inner) / F.greatest(jobs, F.lit(1)), F.lit(1.0)), F.lit(0.0))
    return share, F.when(share > 0.05, F.floor(elapsed * (1 - share) / share))


def verified(files: DataFrame, packs: DataFrame) -> DataFrame:
    """name, ok: whether each pack's content has its size and SHA-256. files: name, content; packs: name, bytes, sha256."""
    right = (F.length("content") == F.col("bytes")) & (F.sha2("content", 256) == F.lower("sha256"))
    return packs.join(files.select("name", "content"), "name", "left").select("name", F.coalesce(right, F.lit(False)).alias("ok"))


def chosen_pack(registry: DataFrame, files: DataFrame, code: str) -> str:
    """The file name of a language pack. registry: code, name, bytes, sha256. Never another pack instead: errors say what is wrong."""
    wanted = registry.filter(F.col("code") == code)
    rows = wanted.join(verified(files, wanted), "name").join(files.select("name", F.lit(True).alias("there")).distinct(), "name", "left").collect()  # a row a pack of one code
    if not rows:
        raise ValueError(f"no language pack is known as {code}")
    if not rows[0].there:
        raise FileNotFoundError(f"the language pack {rows[0].name} is not installed")
    if not rows[0].ok:
        raise ValueError(f"the language pack {rows[0].name} is damaged")
    return rows[0].name
