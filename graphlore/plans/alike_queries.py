"""Queries over all pairs of vectors that are alike; the vectors are made of the words of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlore.operators.alike import Alike, within
from graphlore.operators.vectors import hashed_words
from graphlore.plans.registry import query
from graphlore.plans.shared import cut

THRESHOLD = 0.98
HASHED = r"""words AS (SELECT doc_id AS id, md5(unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS h FROM documents),
sums AS (SELECT id, ('0x' || h[1:2])::INT % 64 AS i, sum(CASE WHEN ('0x' || h[3:4])::INT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM words GROUP BY ALL),
vecs AS (SELECT d.id, list(coalesce(x, 0.0) ORDER BY r.i) AS v FROM (SELECT DISTINCT id FROM sums) d CROSS JOIN (SELECT range AS i FROM range(64)) r LEFT JOIN sums s ON s.id = d.id AND s.i = r.i GROUP BY d.id),
different AS (SELECT v, min(id) AS vector_id, count(*) AS n_copies FROM vecs WHERE len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY v),
alike AS (SELECT x.vector_id AS a, y.vector_id AS b, list_cosine_similarity(x.v, y.v) AS cs FROM different x JOIN different y ON x.vector_id < y.vector_id WHERE list_cosine_similarity(x.v, y.v) >= 0.98)"""


def _documents(spark, sf_dir):
    return cut(hashed_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")), "hashed-words")


@query(f"WITH {HASHED} SELECT a, b, round(cs, 6) AS similarity FROM alike")
def vector_pairs(spark, sf_dir):
    similarity = F.floor(F.col("similarity") * 1e6 + 0.5) / 1e6  # ``round`` goes through decimals, which takes longer than finding the pair
    return Alike(_documents(spark, sf_dir), THRESHOLD, exact=True).pairs().select("a", "b", similarity.alias("similarity"))


@query(f"""WITH {HASHED}, ends AS (SELECT a AS vector_id, b AS o FROM alike UNION ALL SELECT b, a FROM alike),
counted AS (SELECT e.vector_id, count(*) AS n_links, sum(d.n_copies) AS others FROM ends e JOIN different d ON d.vector_id = e.o GROUP BY 1)
SELECT s.id, d.vector_id, d.n_copies, coalesce(c.n_links, 0)::BIGINT AS n_links, (coalesce(c.others, 0) + d.n_copies - 1)::BIGINT AS n_row_links
FROM vecs s JOIN different d ON d.v = s.v LEFT JOIN counted c ON c.vector_id = d.vector_id""")
def vector_links(spark, sf_dir):
    """One row a document: the document that stands for its vector, and how many vectors and documents are alike to it."""
    return Alike(_documents(spark, sf_dir), THRESHOLD, exact=True).links()


@query()
def vector_pairs_work(spark, sf_dir):
    """Pairs among which the join decides, and the share that it finds of the pairs of every fiftieth document, looked up exactly; only those are compared here."""
    rows = _documents(spark, sf_dir)
    alike = Alike(rows, THRESHOLD, exact=True)
    named = cut(alike.members.filter("id = vector_id").select("id").join(rows, "id"), "named-vectors")  # read once for each block of queries
    near = within(named, named.filter("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("q")), THRESHOLD).filter("id <> query")
    near = near.select(F.least("id", "query").alias("a"), F.greatest("id", "query").alias("b")).distinct()
    hit = near.join(alike.pairs(every=50).select("a", "b", F.lit(1).alias("hit")).hint("merge"), ["a", "b"], "left")
    share = hit.agg(F.count(F.lit(1)).alias("n_asked"), F.count("hit").alias("n_found"))
    return alike.compared().join(F.broadcast(share)).withColumn("share_compared", F.round(F.col("n_compared") / F.greatest("n_all", F.lit(1)), 4))
