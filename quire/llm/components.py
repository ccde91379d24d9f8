"""Connected components of a link table in Spark, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import forget, stored


#: Ids of more than 1 / HOT of all rows are fewer than HOT; their least neighbours are broadcast.
HOT = 10_000


def _with_least(edges: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """rows (a, b) with m, the least b of a in edges. A hub's rows stay where they are instead of meeting in one task."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hubs = least.filter(F.col("n") * HOT > total).select("a", "m")
    marked = rows.join(F.broadcast(hubs), "a", "left")
    others = marked.filter("m IS NULL").drop("m").join(least.filter(F.col("n") * HOT <= total).select("a", "m"), "a")
    return marked.filter("m IS NOT NULL").select("a", "b", "m").union(others.select("a", "b", "m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = _with_least(both, both.filter("b > a"), 2 * n)
    return found.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    found = _with_least(edges, edges, n)
    links = found.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return links.union(found.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """a, root: the smallest id of each component, for every id that isn't its own root. links: a, b (longs).

    Every round is written to the shared folder, so an executor's loss costs no earlier round.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links", narrow=True)
    mark = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    before = mark(edges)
    while before.n:
        large = stored(_large_star(edges, before.n), "stars", narrow=True)
        forget(edges)
        edges = stored(_small_star(large, mark(large).n), "links", narrow=True)
        forget(large)
        if (after := mark(edges)) == before:
            break
        before = after
    return edges.select("a", F.col("b").alias("root"))
