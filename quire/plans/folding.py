"""Ordered folds over groups of rows, streamed.

Rows are dealt by key and sorted inside partitions (a sort that spills), then one Python iterator walks them and calls
the fold at each change of key. A group of a page or a document costs a list, not a pandas frame of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

EMIT = 4096
#: Bytes of input for a part, and what is no file's size but a plan that doesn't know its own.
PART, UNKNOWN = 4 << 20, 1 << 50


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by key, in parts whose number grows with the bytes of input, so that a part's rows to sort stay as many.

    Parts of a number that is given aren't put together again: judged by their compressed bytes, millions of short rows
    would make one part.
    """
    session, leaves = df.sparkSession, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(leaves.apply(k).stats().sizeInBytes() for k in range(leaves.size()))
    cores = session.sparkContext.defaultParallelism
    parts = -(-size // PART) if size < UNKNOWN else int(session.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(-(-parts // cores), 1) * cores, *keys)  # whole rounds of tasks


def spread(df: DataFrame) -> DataFrame:
    """The rows, dealt evenly over all cores: rows that cost much work may lie in a file of one split.

    The number of parts is given, so that they aren't put together again because their rows are small.
    """
    session = df.sparkSession
    return df.repartition(max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))


def _values(column: pa.Array) -> list:
    """What to_pylist gives, by way of numpy where that is the same and takes a quarter of the time."""
    t = column.type
    plain = pa.types.is_string(t) or (not column.null_count and (pa.types.is_integer(t) or pa.types.is_floating(t)))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def _borders(keys: list[list], n: int) -> list[int]:
    """Where rows of another key begin, with 0 and n."""
    changed = np.zeros(n - 1, bool)
    for values in keys:
        v = np.array(values) if isinstance(values[0], int) and None not in values else np.array([*values, None], object)[:-1]
        changed |= (v[1:] != v[:-1]).astype(bool)
    return [0, *(np.flatnonzero(changed) + 1).tolist(), n]


def folded(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, list[tuple]], list[tuple]], schema: str, together: bool = False) -> DataFrame:
    """fold(key, rows) gives the output rows of each group; rows are tuples of the columns that aren't keys, by order.

    together: a group's rows already lie in one partition, so they needn't move.
    """
    others = [c for c in df.columns if c not in keys]
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    k = len(keys)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for some in batches:
            if not some.num_rows:
                continue
            columns = [_values(c) for c in some.columns]
            for a, b in itertools.pairwise(_borders(columns[:k], some.num_rows)):
                here = tuple(c[a] for c in columns[:k])
                if here != key:
                    if held:
                        out += fold(key, held)
                        if len(out) >= EMIT:
                            yield batch(out)
                            out = []
                    key, held = here, []
                held += zip(*(c[a:b] for c in columns[k:]), strict=True)
        if held:
            out += fold(key, held)
        yield batch(out)

    rows = df.select(*keys, *others)
    return (rows if together else rows.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
