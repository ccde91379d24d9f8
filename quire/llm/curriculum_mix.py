"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Targets: sources share the total size by weight; a target stops at `most` times its source's size and the excess is
reshared by weight until none is above. That is the level L at which the sum of min(cap, L * weight) is the total, and
sorting sources by cap / weight finds it in closed form.

Schedule: source s draws at the rate target_s * (1 + slope_s * (2t - 1)) over training time t in [0, 1]. Its integral,
the cumulative demand, is target_s * (t + slope_s * (t*t - t)); inverting it at a document's place in its source's
order gives the time at which the document is due. Slopes run from -tilt (heaviest weight, drawn early) to +tilt, so
the mixture changes while the totals stay.

A source's order is by MD5 of doc_id. Prefix sums over it are taken in two levels (hash buckets, then inside a bucket),
so no source is ever gathered in one task. So are prefix sums over the sources themselves, of which there may be one for
each web domain: about `parts` sample sources cut their order into ranges, sums of the ranges (at most parts + 1 rows) meet
in one task, and rows of one range in another. The table of sources and cells is written once; joins with it are planned
by its measured size.

Defined cases: null text has size 0 and takes nothing; a null source is the last source; a null doc_id sorts by the
empty string; repeated rows are separate documents whose order among each other doesn't matter, as they are equal; sources
of equal need are stopped in code point order, which leaves their targets equal; very long texts are counted whole; an
empty table gives no rows; other columns are kept by mixed() and ignored by mixture().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import partitions, stored

#: The repeating weights of sources by code point.
WEIGHTS = (5.0, 2.0, 1.0)


def size_of(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranged(rows: DataFrame, order: tuple[str, ...], parts: int) -> DataFrame:
    """rows with `range`: the number of sampled rows that aren't above each in the given order."""
    sample = rows.select(*order).orderBy(F.xxhash64(*order)).limit(parts).collect()  # parts rows at most
    if not sample:
        return rows.withColumn("range", F.lit(0))
    kinds = dict(rows.dtypes)
    marks = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in order]) for r in sample])
    return rows.withColumn("range", F.size(F.filter(marks, lambda m: m <= F.struct(*order))))


def _summed(rows: DataFrame, order: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """rows, which have a range, with prefix sums over all rows in the given order, each row included."""
    by_range = rows.groupBy("range").agg(*[F.sum(x).alias(f"{name}_all") for name, x in sums.items()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = by_range.select("range", *[F.coalesce(F.sum(f"{name}_all").over(earlier), F.lit(0)).alias(f"{name}_base") for name in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", *[F.sum(x).over(inside).alias(f"{name}_own") for name, x in sums.items()])
    out = own.join(F.broadcast(base), "range")
    return out.select(*rows.columns, *[(F.col(f"{name}_base") + F.col(f"{name}_own")).alias(name) for name in sums])


def targets(sizes: DataFrame, most: float = 3.0, tilt: float = 0.5, parts: int = 64) -> DataFrame:
    """By source: source_size, weight, target, slope. sizes: source, source_size; a row for each source."""
    sizes = sizes.select("source", F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name"), F.col("source_size").cast("double").alias("amount"), "source_size")
    ranked = _summed(_ranged(sizes, ("last", "name"), parts), ("last", "name"), {"nth": F.lit(1)}).withColumn("turn", F.pmod(F.col("nth") - 1, F.lit(len(WEIGHTS))))
    weighed = ranked.select("source", "last", "name", "source_size", "amount", "turn", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("turn") + 1).cast("int")).alias("weight"))
    need = stored(weighed.withColumn("need", F.lit(most) * F.col("amount") / F.col("weight")), "needs", narrow=True)
    order = ("need", "last", "name")
    summed = _summed(_ranged(need, order, parts), order, {"sizes": F.col("amount"), "weights": F.col("weight")})
    total = need.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    # caps stop the sources in this order; the first whose cap is above the level that the rest would have sets it
    level = (F.lit(total.size) - F.lit(most) * (F.col("sizes") - F.col("amount"))) / (F.lit(total.weight) - F.col("weights") + F.col("weight"))
    first = summed.filter(F.col("need") > level).agg(F.min(F.struct("need", "last", "name", level.alias("level"))).alias("f")).first().f
    cap = F.lit(most) * F.col("amount")
    target = cap if first is None else F.when(F.struct(*order) >= F.struct(F.lit(first["need"]), F.lit(first["last"]), F.lit(first["name"])), F.least(cap, F.lit(first["level"]) * F.col("weight"))).otherwise(cap)
    return need.select("source", "source_size", "weight", target.alias("target"), (F.lit(tilt) * (F.col("turn") - 1)).alias("slope"))


def mixture(docs: DataFrame, most: float = 3.0, tilt: float = 0.5, buckets: int | None = None) -> DataFrame:
    """One row per document: size, its source's size and target, the words taken, and the time of its first use."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    return placed(rows, most, tilt, buckets)


def placed(rows: DataFrame, most: float = 3.0, tilt: float = 0.5, buckets: int | None = None) -> DataFrame:
    n = buckets or max(64, 4 * partitions(rows.sparkSession))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("key", key).withColumn("bucket", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("int"))
    cells = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("cell")), "cells", narrow=True)
    per_source = targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), most, tilt)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "bucket", F.coalesce(F.sum("cell").over(earlier), F.lit(0)).alias("base"))
    joined = cells.join(per_source, cells.source.eqNullSafe(per_source.source)).select(cells.source.alias("c_source"), F.col("bucket").alias("c_bucket"), "base", "source_size", "target", "slope")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("upto", F.sum("size").over(inside))
    out = here.join(joined, here.source.eqNullSafe(joined.c_source) & (here.bucket == joined.c_bucket))
    end = F.col("base") + F.col("upto")
    start = end - F.col("size")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)
    extra = F.greatest(F.lit(0), F.round((ratio - whole) * F.col("source_size")).cast("long"))  # words of one more, partial, pass
    taken = (whole * F.col("size") + F.greatest(F.lit(0), F.least(extra - start, F.col("size")))).cast("long")
    fraction = F.when(taken > 0, start / F.col("target"))
    return out.select(here.doc_id, here.source, "size", "source_size", "target", taken.alias("taken"), F.round(F.abs(due_time(fraction, F.col("slope"))), 9).alias("position"), fraction.alias("fraction"), "slope")


def due_time(fraction: Column, slope: Column) -> Column:
    """The time at which cumulative demand t + slope * (t*t - t) reaches the fraction."""
    return F.when(slope == 0, fraction).otherwise((slope - 1 + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * fraction)) / (2 * slope))


def mixed(docs: DataFrame, most: float = 3.0, tilt: float = 0.5) -> DataFrame:
    """docs as the mix takes them, range-sorted by training time: a row for each pass over a document (a partial pass counts from half its words)."""
    columns = docs.columns
    rows = docs.select(*[F.col(c).alias(f"own_{c}") for c in columns], size_of(F.col("text")).alias("own size"))
    place = placed(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), most, tilt).filter("taken > 0")
    # equal keys are repeated rows of one document: each gets the mean of what they take together
    place = place.groupBy("doc_id", "source", "size").agg(F.round(F.avg("taken") / F.first("size")).cast("int").alias("times"), F.min("fraction").alias("fraction"), F.first("slope").alias("slope"), F.first(F.col("source_size") / F.col("target")).alias("lap"))
    on = rows["own_doc_id"].eqNullSafe(place["doc_id"]) & rows["own_source"].eqNullSafe(place["source"]) & (rows["own size"] == place["size"])
    joined = rows.join(place.filter("times > 0"), on).withColumn("pass", F.explode(F.expr("sequence(0, times - 1)")))
    at = due_time(F.least(F.lit(1.0), F.col("fraction") + F.col("pass") * F.col("lap")), F.col("slope"))
    return joined.orderBy(at).select(*[F.col(f"own_{c}").alias(c) for c in columns])
