"""Queries that write a vector index, open it again and search it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlore.operators import incremental, index
from graphlore.plans.registry import query
from graphlore.plans.retrieval_queries import VECTORS, _vecs
from graphlore.plans.shared import fresh_path

_TOP = """top AS (
  SELECT q.id AS query, s.id, list_cosine_similarity(s.v, q.v) AS cs, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(s.v, q.v) DESC, s.id) AS rank
  FROM vecs s, vecs q WHERE q.id % 50 = 0 QUALIFY rank <= {})""".format


def _built(spark: SparkSession, rows: DataFrame) -> index.Index:
    path = fresh_path(spark, "vector-index")
    index.build(rows, path)
    return index.Index(spark, path)


def _asked(rows: DataFrame) -> DataFrame:
    return rows.filter("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("q"))


@query(f"WITH {VECTORS}, {_TOP(10)} SELECT query, id, round(cs, 6) AS similarity, rank FROM top")
def index_top10(spark, sf_dir):
    """Every cell probed, so that candidates by codes, read back from the index and ranked exactly, are the exact neighbours."""
    rows = _vecs(spark, sf_dir)
    found = _built(spark, rows)
    return found.search_blocks(_asked(rows), 10, probes=len(found.centres)).select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query()
def index_recall(spark, sf_dir):
    """Only as many cells probed as the index found that it needs: the share of the exact ten neighbours that is found, and of the rows whose codes are read."""
    rows = _vecs(spark, sf_dir)
    found = _built(spark, rows)
    asked = _asked(rows)
    cells = found.probed(asked)
    sizes = found.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    read = cells.join(F.broadcast(sizes), "cell").groupBy("query").agg(F.sum("rows").alias("n")).agg(F.avg("n").alias("read")).join(sizes.agg(F.sum("rows").alias("all")))
    got = index.recall(found.search_blocks(asked, 10), index.neighbours(rows, asked, 10))
    return got.join(read).select("queries", "neighbours", "recall", F.round(F.col("read") / F.col("all"), 4).alias("share_read"))


@query(f"""WITH {VECTORS}, {_TOP(3)}, live AS (SELECT id FROM vecs WHERE id % 50 = 0 OR label < 9),
c AS (SELECT count(*) AS hits, count(DISTINCT (query, id)) AS distinct_hits, count(*) FILTER (id IN (FROM live)) AS live_hits, count(DISTINCT query) AS queries FROM top)
SELECT hits, distinct_hits, live_hits, hits = distinct_hits AND hits = live_hits AND hits = 3 * queries AS sound FROM c""")
def index_probe(spark, sf_dir):
    """The index asked for its own vectors, after rows of one label were taken from the table it was built of."""
    rows = _vecs(spark, sf_dir)
    found = _built(spark, rows)
    hits = found.search_blocks(_asked(rows), 3, probes=len(found.centres)).select("query", "id")
    return incremental.probe(hits, rows.filter("id % 50 = 0 OR label < 9").select("id"), 3)
