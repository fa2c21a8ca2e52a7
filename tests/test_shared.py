"""Tables in the shared folder: scopes of their own, no local folder on a cluster, bounded batches."""

from __future__ import annotations

import types

import pytest
from pyspark.sql import functions as F

from graphlore.operators import vectors
from graphlore.plans import shared


def exists(spark, table) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._shared_path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_scopes_leave_each_other_alone(spark):
    with shared.tables() as outer:
        first = shared.cut(spark.range(3), "first")
        with shared.tables() as inner:
            gone, kept = shared.cut(spark.range(4), "gone"), shared.cut(spark.range(5), "kept")
            inner(kept)
        assert not exists(spark, gone) and exists(spark, kept) and exists(spark, first)
        last = shared.cut(spark.range(6), "last")
        outer(last)
    assert not exists(spark, first) and exists(spark, kept) and last.count() == 6


def test_no_local_folder_on_a_cluster():
    def session(master: str):
        conf = types.SimpleNamespace(get=lambda *a: None)
        return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, getConf=lambda: conf))

    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            shared.shared_folder(session(master))


def test_batches_only_get_smaller(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "50")
        shared.bound_batches(spark, rows=200)
        assert spark.conf.get(name) == "50"
        spark.conf.set(name, "100000")
        shared.bound_batches(spark, rows=200, mb=2)
        assert spark.conf.get(name) == "200" and shared._number(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20
    finally:
        spark.conf.set(name, before)


def test_queries_in_blocks(spark):
    rows = spark.range(60).select("id", F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).cast("array<float>").alias("embedding"))
    queries = rows.filter("id % 3 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    key = lambda df: sorted((r.query, r.rank, r.id, round(r.similarity, 9)) for r in df.collect())
    assert key(vectors.knn_blocks(rows, queries, 3, block=8)) == key(vectors.knn_batch(rows, queries, 3))
