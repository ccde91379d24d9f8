"""Windows over large tables."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from quire.operators import page
from quire.operators import relational as R
from quire.plans import folding


def test_clusters_are_dealt_by_size(spark, tmp_path, monkeypatch):
    """The parts to sort grow in number with the input, not in rows, however few bytes their rows take when compressed."""
    rng = np.random.default_rng(4)
    key, value = rng.integers(0, 40, 300_000), rng.random(300_000) * 1000
    pq.write_table(pa.table({"k": key, "v": value}), f"{tmp_path}/some.parquet")
    monkeypatch.setattr(folding, "PART", 100_000)
    found = R.gap_clusters(spark.read.parquet(f"{tmp_path}/some.parquet"), ["k"], "v", 0.3)
    assert found.rdd.getNumPartitions() >= 20
    rows = found.orderBy("k", "cluster").collect()
    want = [(k, *page.clusters(value[key == k], 0.3)) for k in range(40)]
    assert [(r.k, r.cluster, r.n) for r in rows] == [(k, c + 1, n) for k, _, some in want for c, n in enumerate(some.tolist())]
    assert np.allclose([r["mean"] for r in rows], np.concatenate([m for _, m, _ in want]))
    assert R.gap_clusters(spark.createDataFrame([(1, 2.0)], "k long, v double").filter(F.col("k") > 1), ["k"], "v", 0.3).count() == 0
