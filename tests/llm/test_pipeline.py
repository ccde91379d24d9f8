import corpus_pipeline
import duckdb
import pytest
from quire.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(oracle.ORACLES[name]).df()
    found = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    plain = lambda df: sorted([tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist()], key=repr)
    assert plain(found) == plain(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() >= 0.7 * first, name
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
