"""Spark helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that driver and executors share. Only local sessions, as in tests, get one of their own."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quire-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Setting by which Spark drops a query's shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


#: Files for each core that a narrow table is written to at most.
FILES = 4


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df once into the shared folder and read it back: later reads start there, also when executors are lost.

    The shuffles of df go as soon as it is written. A narrow table (numbers and hashes, no texts) goes to few files: its
    partitions are written one after the other by FILES tasks a core, instead of to a file each.
    """
    spark = df.sparkSession
    df = df.coalesce(FILES * spark.sparkContext.defaultParallelism) if narrow else df
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, {_CLEANUP: "true"} | MODEST):
        df.write.parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more."""
    for df in tables:
        if df.stored_at in _made:
            _made.remove(df.stored_at)
            remove(df.sparkSession, df.stored_at)


def clear(spark: SparkSession) -> None:
    """Delete all stored tables; for a caller that has written its result."""
    while _made:
        remove(spark, _made.pop())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, n: int, column: str) -> DataFrame:
    """Rows with column = k go to partition k of n."""
    return df.repartitionById(n, F.col(column).cast("int"))


def docs_of(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


@contextmanager
def settings(spark: SparkSession, some: dict[str, str]) -> Iterator[None]:
    """Jobs that run inside have these settings; the session's own return afterwards."""
    before = {k: spark.conf.get(k, None) for k in some}
    for k, v in some.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Batches that Python workers get: at most so many rows and bytes, as a row may be a whole text.
MODEST = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def modest(spark: SparkSession) -> None:
    """From now on the session hands Python workers modest batches, also where rows are returned and read later."""
    for k, v in MODEST.items():
        spark.conf.set(k, v)


#: Keys that hold more than 1 / HOT of all rows are fewer than HOT.
HOT = 10_000


def hub_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with a table of one row a key. n in the table: how many rows the key has, of `total` in all.

    Rows of hubs, keys with more than 1 / HOT of the rows, stay where they are: the fewer than HOT hubs are broadcast.
    """
    hub = F.col("n") * HOT > total
    hubs = table.filter(hub).drop("n")
    near = rows.join(F.broadcast(hubs), key)
    far = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(table.filter(~hub).drop("n"), key)
    return near.unionByName(far)


#: Rows of a table of keys that is broadcast as a whole (a few MB).
FEW = 100_000


def few_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """hub_join(), for a table that is likely small: it is counted, and broadcast if it has FEW rows at most."""
    return rows.join(F.broadcast(table.drop("n")), key) if table.limit(FEW + 1).count() <= FEW else hub_join(rows, table, key, total)
