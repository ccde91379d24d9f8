"""Every query with a DuckDB statement, compared row by row on the smallest tables."""

import duckdb
import pytest
from quire.plans import catalogue, outputs  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def plain(df, columns):
    cell = lambda x: round(x, 7) if isinstance(x, float) else x
    return sorted([tuple(map(cell, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist()], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, con, name):
    want, found = con.execute(catalogue.ORACLES[name]).df(), catalogue.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    assert len(found) and plain(found, columns) == plain(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
