"""Queries on vectors, fusion and graphs, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlore.operators import fusion, graph, vectors
from graphlore.plans.registry import query
from graphlore.sources.pack import Pack

def _STRIP(x: str) -> str:  # noqa: N802
    """Without white space of any kind at either end."""
    white = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
    return f"regexp_replace({x}, '^{white}+|{white}+$', '', 'g')"


PACK = """section AS (
  SELECT e.vec_id AS id, 'doc-' || d.doc_id AS article, 'doc-' || d.doc_id AS title, d.text AS content, CAST(e.embedding AS DOUBLE[]) AS v, e.label, d.lang AS category
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
links AS (
  SELECT src, dst FROM (SELECT id AS src, unnest([(id * 7 + 3) % n, (id * 13 + 5) % n]) AS dst FROM section, (SELECT count(*) AS n FROM section)) WHERE src <> dst)"""


def _near(source: str, qid: int, k: int, name: str = "near") -> str:
    return f"""{name} AS (
  SELECT s.id, list_cosine_similarity(s.v, q.v) AS cs, row_number() OVER (ORDER BY list_cosine_similarity(s.v, q.v) DESC, s.id) AS r
  FROM {source} s, (SELECT v FROM {source} WHERE id = {qid}) q QUALIFY r <= {k})"""


VECTORS = "vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
CENTRES = """centre AS (SELECT label, list(m ORDER BY i) AS v FROM (
  SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs) GROUP BY label, i) GROUP BY label)"""
SIX = "round({}, 6)".format


def _vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")


@query(f"WITH {VECTORS}, {_near('vecs', 0, 10)} SELECT id, round(greatest(0, least(1, cs)), 6) AS score, r AS rank FROM near")
def knn_cosine_topk(spark, sf_dir):
    rows = _vecs(spark, sf_dir)
    return vectors.vector_retrieve(rows, vectors.vector_of(rows, 0), 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {VECTORS}, {CENTRES}
SELECT centre.label AS query, vecs.id, round(list_cosine_similarity(vecs.v, centre.v), 6) AS similarity,
  row_number() OVER (PARTITION BY centre.label ORDER BY list_cosine_similarity(vecs.v, centre.v) DESC, vecs.id) AS rank
FROM vecs, centre QUALIFY rank <= 3""")
def knn_batch_top3(spark, sf_dir):
    rows = _vecs(spark, sf_dir)
    queries = vectors.centroids(rows, "label").withColumnRenamed("label", "query")
    return vectors.knn_batch(rows, queries, 3).select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"WITH {VECTORS}, {_near('vecs', 1, 3)} SELECT id, round(cs, 6) AS similarity, r AS rank FROM near")
def fewshot_select(spark, sf_dir):
    rows = _vecs(spark, sf_dir)
    return vectors.knn(rows.select("id", "embedding"), vectors.vector_of(rows, 1), 3).select("id", F.round("similarity", 6).alias("similarity"), "rank")


_INT8 = """q AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) / 127.0 AS scale FROM vecs),
d AS (SELECT *, list_transform(v, lambda x: CASE WHEN scale = 0 THEN 0.0 ELSE greatest(-127, least(127, floor(x / scale + 0.5))) END) AS codes FROM q),
back AS (SELECT *, list_transform(codes, lambda c: CAST(CAST(c * scale AS FLOAT) AS DOUBLE)) AS w FROM d)"""


@query(f"""WITH {VECTORS}, {_INT8} SELECT label, count(*) AS vectors, round(avg(list_cosine_similarity(v, w)), 6) AS mean_cosine,
  round(min(list_cosine_similarity(v, w)), 6) AS min_cosine, round(max(scale), 9) AS max_scale FROM back GROUP BY label""")
def embedding_int8_roundtrip(spark, sf_dir):
    rows = _vecs(spark, sf_dir).withColumn("c", vectors.quantize(F.col("embedding")))
    same = vectors.cosine(vectors.doubles(F.col("embedding")), vectors.doubles(vectors.dequantize(F.col("c"), 64)))
    rows = rows.select("label", "c.scale", same.alias("s"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg("s"), 6).alias("mean_cosine"), F.round(F.min("s"), 6).alias("min_cosine"), F.round(F.max("scale"), 9).alias("max_scale"))


@query(f"""WITH {VECTORS}, {CENTRES}, {_INT8},
a AS (SELECT centre.label AS query, back.id FROM back, centre QUALIFY row_number() OVER (PARTITION BY centre.label ORDER BY list_cosine_similarity(back.v, centre.v) DESC, back.id) <= 10),
b AS (SELECT centre.label AS query, back.id FROM back, centre QUALIFY row_number() OVER (PARTITION BY centre.label ORDER BY list_cosine_similarity(back.w, centre.v) DESC, back.id) <= 10)
SELECT a.query, count(b.id) / 10.0 AS hit_at_10 FROM a LEFT JOIN b USING (query, id) GROUP BY a.query""")
def int8_hit_at_k(spark, sf_dir):
    rows = _vecs(spark, sf_dir)
    queries = vectors.centroids(rows, "label").withColumnRenamed("label", "query")
    coded = rows.select("id", vectors.dequantize(vectors.quantize(F.col("embedding"))).alias("embedding"))
    exact, approx = vectors.knn_batch(rows, queries, 10).select("query", "id"), vectors.knn_batch(coded, queries, 10).select("query", "id", F.lit(1).alias("hit"))
    return exact.join(approx, ["query", "id"], "left").groupBy("query").agg((F.count("hit") / F.lit(10.0)).alias("hit_at_10"))


@query(f"""WITH {VECTORS}, {CENTRES}, top AS (
  SELECT centre.label AS query, vecs.label, row_number() OVER (PARTITION BY centre.label ORDER BY list_cosine_similarity(vecs.v, centre.v) DESC, vecs.id) AS r FROM vecs, centre QUALIFY r <= 5)
SELECT k, avg(hit) AS recall FROM (SELECT k, query, max(CASE WHEN label = query AND r <= k THEN 1.0 ELSE 0.0 END) AS hit FROM top, (SELECT unnest([1, 3, 5]) AS k) GROUP BY k, query) GROUP BY k""")
def label_recall_at_k(spark, sf_dir):
    rows = _vecs(spark, sf_dir)
    top = vectors.knn_batch(rows, vectors.centroids(rows, "label").withColumnRenamed("label", "query"), 5).join(rows.select("id", "label"), "id")
    each = top.select("query", "label", "rank", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("k"))
    hit = F.max(F.when((F.col("label") == F.col("query")) & (F.col("rank") <= F.col("k")), 1.0).otherwise(0.0))
    return each.groupBy("k", "query").agg(hit.alias("hit")).groupBy("k").agg(F.avg("hit").alias("recall"))


@query(f"""WITH {VECTORS} SELECT label, count(*) AS vectors, count(*) FILTER (len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) AS healthy,
  round(avg(sqrt(list_dot_product(v, v))), 6) AS mean_norm FROM vecs GROUP BY label""")
def embedding_health(spark, sf_dir):
    v = vectors.doubles(F.col("embedding"))
    rows = _vecs(spark, sf_dir).select("label", vectors.healthy(F.col("embedding"), 64).alias("ok"), F.sqrt(vectors.dot(v, v)).alias("norm"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count_if("ok").alias("healthy"), F.round(F.avg("norm"), 6).alias("mean_norm"))


@query(f"""WITH {PACK} SELECT category, round(max(cs), 6) AS similarity, min_by(id, (-cs, id)) AS id FROM (
  SELECT s.category, s.id, list_cosine_similarity(s.v, q.v) AS cs FROM section s, (SELECT v FROM section WHERE id = 0) q WHERE s.id <> 0) GROUP BY category""")
def category_centroid_nearest(spark, sf_dir):
    s = Pack.derive(spark, sf_dir).section
    q = vectors.vector_of(s, 0).select(vectors.doubles(F.col("q")).alias("q"))
    scored = s.filter("id <> 0").join(F.broadcast(q)).select("category", "id", vectors.cosine(vectors.doubles(F.col("embedding")), F.col("q")).alias("cs"))
    best = scored.groupBy("category").agg(F.min(F.struct((-F.col("cs")).alias("d"), "id")).alias("b"))
    return best.select("category", F.round(-F.col("b.d"), 6).alias("similarity"), "b.id")


QUESTION = "What about the doc-1 and doc-22 of section doc-1 please"


def _hybrid_sql(weights: tuple[float, float, float], words: list[str], k: int) -> str:
    word_rows = " UNION ALL ".join(
        f"SELECT * FROM (SELECT id, {weights[2] * fusion.KEYWORD} AS delta, 2 AS step, {i} AS pos, row_number() OVER (ORDER BY id) AS sub FROM section WHERE contains(lower(title), '{w.lower()}') QUALIFY sub <= {k})"
        for i, w in enumerate(words))
    return f"""WITH {PACK}, {_near('section', 0, k)}, signals AS (
SELECT id, {weights[0]} * greatest(0, least(1, cs)) AS delta, 0 AS step, r AS pos, 0 AS sub FROM near
UNION ALL SELECT dst, {weights[1] * fusion.NEIGHBOUR}, 1, r, row_number() OVER (PARTITION BY r ORDER BY dst) FROM near JOIN links ON src = id JOIN section s2 ON s2.id = dst WHERE r <= 3
UNION ALL {word_rows}),
added AS (SELECT id, sum(delta) AS score, min((step, pos, sub)) AS seen FROM signals GROUP BY id)
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, seen, id) AS rank FROM added QUALIFY rank <= {k}"""


_WORDS = ["about", "doc-1", "doc-22"]


def _hybrid(spark, sf_dir, weights):
    p = Pack.derive(spark, sf_dir)
    words = spark.range(1).select(fusion.keywords(F.lit(QUESTION)).alias("w")).first()["w"]
    got = fusion.hybrid_retrieve(p.section, p.links_to, vectors.vector_of(p.section, 0), words, 10, weights)
    return got.withColumn("score", F.round("score", 6))


@query(_hybrid_sql(fusion.WEIGHTS, _WORDS, 10))
def hybrid_retrieve(spark, sf_dir):
    return _hybrid(spark, sf_dir, fusion.WEIGHTS)


@query(_hybrid_sql((0.5, 0.3, 0.0), _WORDS, 10))
def hybrid_keyword_off(spark, sf_dir):
    return _hybrid(spark, sf_dir, (0.5, 0.3, 0.0))


_STOP = "[" + ", ".join(f"'{w}'" for w in fusion.STOP_WORDS) + "]"


@query(f"""SELECT item_id, array_to_string(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 3 AND NOT list_contains({_STOP}, lower(w)))[1:3], '|') AS keywords FROM benchmark""")
def keyword_extract(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.array_join(fusion.keywords(F.col("text")), "|").alias("keywords"))


_TERMS = """(SELECT array_to_string(list(t ORDER BY i)[1:12], '|') FROM (SELECT t, min(i) AS i FROM (
  SELECT unnest(list_prepend(p, regexp_split_to_array(p, '[\\s/@:;,]+'))) AS t, generate_subscripts(list_prepend(p, regexp_split_to_array(p, '[\\s/@:;,]+')), 1) AS i) WHERE length(t) >= 2 GROUP BY t))"""


@query(f"SELECT page_id, {_TERMS} AS terms FROM (SELECT page_id, {_STRIP('lower(chr(9) || url || chr(10))')} AS p FROM pages)")
def lexical_terms(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.array_join(fusion.lexical_terms(F.concat(F.lit("\t"), "url", F.lit("\n"))), "|").alias("terms"))


PHRASE = "red widget/Brand#1;economy"
FIELDS = ["p_name", "p_brand", "p_type", "code"]
_PARTS = "parts AS (SELECT p_partkey AS id, p_name, p_brand, p_type, CAST(p_partkey AS VARCHAR) AS code FROM part)"
_ANY = " OR ".join(f"contains(lower({f}), term)" for f in FIELDS)
_LEX = f"""{_PARTS}, terms AS (SELECT unnest(['red widget/brand#1;economy', 'red', 'widget', 'brand#1', 'economy']) AS term, unnest([0, 1, 2, 3, 4]) AS t),
hits AS (SELECT id, t, row_number() OVER (PARTITION BY t ORDER BY id) AS n FROM parts, terms WHERE {_ANY} QUALIFY n <= 200),
lex AS (SELECT id, count(DISTINCT t) / 5.0 AS score, min((t, n)) AS seen FROM hits GROUP BY id),
lexical AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, seen, id) AS rank FROM lex QUALIFY rank <= 10)"""


def _parts(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", F.col("p_partkey").cast("string").alias("code"))


@query(f"WITH {_LEX} SELECT * FROM lexical")
def lexical_retrieve(spark, sf_dir):
    return fusion.lexical_retrieve(_parts(spark, sf_dir), PHRASE, FIELDS, 10)


@query(f"""WITH {VECTORS}, {_near('vecs', 0, 10)}, {_LEX}, both_ AS (SELECT id, score, 0 AS source FROM lexical UNION ALL SELECT id, greatest(0, least(1, cs)), 1 FROM near)
SELECT id, round(max(score), 6) AS score, min_by(source, (-score, source)) AS source FROM both_ GROUP BY id""")
def lexical_union_vector(spark, sf_dir):
    rows = _vecs(spark, sf_dir)
    got = fusion.union_by_max(fusion.lexical_retrieve(_parts(spark, sf_dir), PHRASE, FIELDS, 10), vectors.vector_retrieve(rows, vectors.vector_of(rows, 0), 10))
    return got.withColumn("score", F.round("score", 6))


@query(f"""WITH {VECTORS}, {_near('vecs', 0, 10)}, {_near('vecs', 1, 10, 'other')}, both_ AS (SELECT id, greatest(0, least(1, cs)) AS score, 0 AS source FROM near UNION ALL SELECT id, 1.0, 1 FROM other)
SELECT id, round(max(score), 6) AS score, arg_max(source, (score, source)) AS source FROM both_ GROUP BY id""")
def generated_rows_merge(spark, sf_dir):
    rows = _vecs(spark, sf_dir)
    made = vectors.vector_retrieve(rows, vectors.vector_of(rows, 1), 10).select("id", F.lit(1.0).alias("score"))
    return fusion.union_second_wins(vectors.vector_retrieve(rows, vectors.vector_of(rows, 0), 10), made).withColumn("score", F.round("score", 6))


@query(f"""WITH {PACK}, {_near('section', 0, 40)}, cand AS (SELECT id, greatest(0, least(1, cs)) AS score, r FROM near),
nb AS (SELECT src AS a, dst AS b FROM links UNION ALL SELECT dst, src FROM links),
boost AS (SELECT b AS id, sum(score * 0.5 / 2) AS g FROM nb JOIN cand ON a = id WHERE r <= 5 GROUP BY b)
SELECT cand.id, round(score + coalesce(g, 0), 6) AS score, row_number() OVER (ORDER BY round(score + coalesce(g, 0), 9) DESC, r, cand.id) AS rank FROM cand LEFT JOIN boost USING (id)""")
def graph_rerank(spark, sf_dir):
    p = Pack.derive(spark, sf_dir)
    cand = vectors.vector_retrieve(p.section, vectors.vector_of(p.section, 0), 40)
    return fusion.graph_rerank(cand, p.links_to).withColumn("score", F.round("score", 6))


@query(f"""WITH {PACK}, {_near('section', 3, 50)}, best AS (SELECT article, category, max(cs) AS s FROM near JOIN section USING (id) WHERE article <> 'doc-3' GROUP BY ALL)
SELECT article, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, article) AS rank FROM best WHERE category = 'en' AND s >= 0.05 QUALIFY rank <= 10""")
def seed_semantic_search(spark, sf_dir):
    s = Pack.derive(spark, sf_dir).section
    return fusion.seed_neighbours(s, "doc-3", 10, "en", 0.05).withColumn("similarity", F.round("similarity", 6))


_HOPS = """hops AS (
  SELECT id AS node, 0 AS depth FROM section WHERE article = '{a}'
  UNION SELECT dst, 1 FROM section JOIN links ON src = id WHERE article = '{a}'
  UNION SELECT l2.dst, 2 FROM section JOIN links l1 ON l1.src = id JOIN links l2 ON l2.src = l1.dst WHERE article = '{a}'
  UNION SELECT l3.dst, 3 FROM section JOIN links l1 ON l1.src = id JOIN links l2 ON l2.src = l1.dst JOIN links l3 ON l3.src = l2.dst WHERE article = '{a}'),
near_by AS (SELECT article, category, min(depth) AS depth FROM hops JOIN section ON id = node WHERE depth <= {d} GROUP BY ALL)"""


@query(f"""WITH {PACK}, {_near('section', 3, 50)}, {_HOPS.format(a='doc-3', d=2)},
vec AS (SELECT article, max(cs) AS s FROM near JOIN section USING (id) WHERE article <> 'doc-3' GROUP BY article),
prox AS (SELECT article, (2 - depth + 1) / 2.0 AS p FROM near_by WHERE depth >= 1 AND article <> 'doc-3')
SELECT article, round(0.7 * coalesce(s, 0) + 0.3 * coalesce(p, 0), 6) AS score, row_number() OVER (ORDER BY round(0.7 * coalesce(s, 0) + 0.3 * coalesce(p, 0), 9) DESC, article) AS rank
FROM vec FULL JOIN prox USING (article) QUALIFY rank <= 10""")
def seed_hybrid_search(spark, sf_dir):
    p = Pack.derive(spark, sf_dir)
    return fusion.seed_hybrid(p.section, p.links_to, "doc-3").withColumn("score", F.round("score", 6))


def _neighbourhood(depth: int, category: str | None):
    where = f"WHERE category = '{category}'" if category else ""
    sql = f"WITH {PACK}, {_HOPS.format(a='doc-5', d=depth)} SELECT article, CAST(depth AS BIGINT) AS depth FROM near_by {where} ORDER BY depth, article LIMIT 50"

    def run(spark, sf_dir):
        p = Pack.derive(spark, sf_dir)
        return graph.neighbourhood(p.section, p.links_to, "doc-5", depth, 50, category)

    return sql, run


for _depth in (1, 2, 3):
    _sql, _run = _neighbourhood(_depth, None)
    query(_sql, f"link_neighbourhood_d{_depth}")(_run)
_sql, _run = _neighbourhood(3, "en")
query(_sql, "neighbourhood_category")(_run)


@query(f"""WITH {PACK}, {_HOPS.format(a='doc-5', d=3)}, n AS (SELECT article FROM near_by ORDER BY depth, article LIMIT 50),
pairs AS (SELECT DISTINCT a.article AS source, b.article AS target FROM links JOIN section a ON a.id = src JOIN section b ON b.id = dst)
SELECT source, target, 'internal' AS link_type, 1.0::DOUBLE AS weight FROM pairs WHERE source IN (FROM n) AND target IN (FROM n) ORDER BY source, target LIMIT 1000""")
def neighbourhood_edges(spark, sf_dir):
    p = Pack.derive(spark, sf_dir)
    nodes = graph.neighbourhood(p.section, p.links_to, "doc-5", 3, 50)
    return graph.edges_among(graph.article_links(p.section, p.links_to), nodes)


@query(f"""WITH {PACK} SELECT a.article, count(DISTINCT b.article) AS links_count FROM section a LEFT JOIN links ON a.id = src LEFT JOIN section b ON b.id = dst GROUP BY a.article""")
def links_count(spark, sf_dir):
    p = Pack.derive(spark, sf_dir)
    pairs = graph.article_links(p.section, p.links_to)
    return p.section.select("article").distinct().join(pairs, F.col("article") == F.col("source"), "left").groupBy("article").agg(F.count("target").alias("links_count"))


@query(f"""WITH {PACK} SELECT b.article, count(DISTINCT a.article) AS n_backlinks, min(a.article) AS first_backlink FROM links JOIN section a ON a.id = src JOIN section b ON b.id = dst GROUP BY b.article""")
def backlinks(spark, sf_dir):
    p = Pack.derive(spark, sf_dir)
    return graph.article_links(p.section, p.links_to).groupBy(F.col("target").alias("article")).agg(F.count(F.lit(1)).alias("n_backlinks"), F.min("source").alias("first_backlink"))


_HE = "he AS (SELECT DISTINCT l_orderkey AS article, l_partkey AS e FROM lineitem)"


def _walk_sql(limit: int, depth: int, where: str = "") -> str:
    out, prev = [f"WITH {_HE}, s0 AS (SELECT 1::BIGINT AS e, 0::BIGINT AS depth)"], "s0"
    for d in range(1, depth + 1):
        front = f"(SELECT e FROM {prev} WHERE depth = {d - 1})"
        out.append(f"n{d} AS (SELECT a, b FROM (SELECT DISTINCT x.e AS a, y.e AS b FROM he x JOIN he y USING (article) WHERE x.e IN {front} AND x.e <> y.e {where}) QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= {limit})")
        out.append(f"s{d} AS (SELECT * FROM {prev} UNION ALL SELECT DISTINCT b, {d} FROM n{d} WHERE b NOT IN (SELECT e FROM {prev}))")
        prev = f"s{d}"
    return ", ".join(out) + f" SELECT e AS entity_id, depth FROM {prev} ORDER BY depth, e LIMIT {limit}"


def _walk(depth: int, kind: str | None = None):
    def run(spark, sf_dir):
        p = Pack.derive(spark, sf_dir)
        kinds = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("type"))
        return graph.entity_walk(lambda frontier: graph.co_occurrence(p.has_entity, frontier), 1, depth, 50, kinds, kind, spark)

    return run


query(_walk_sql(50, 1), "entity_cooccurrence_d1")(_walk(1))
query(_walk_sql(50, 2), "entity_cooccurrence_d2")(_walk(2))
query(_walk_sql(50, 2, "AND y.e IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')"), "entity_type_filtered")(_walk(2, "ECONOMY"))

_REL = """rel AS (SELECT DISTINCT 'part-' || l_partkey AS s, 'supplier-' || l_suppkey AS t, 'supplied_by' AS r FROM lineitem
UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'located_in' FROM supplier UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey, 'part_of' FROM nation),
both_ AS (SELECT s AS a, t AS b FROM rel UNION SELECT t, s FROM rel)"""


@query(f"""WITH {_REL}, n1 AS (SELECT b FROM both_ WHERE a = 'region-1' ORDER BY b LIMIT 50), s1 AS (SELECT 'region-1' AS e, 0 AS depth UNION ALL SELECT b, 1 FROM n1),
n2 AS (SELECT DISTINCT b FROM (SELECT a, b FROM both_ WHERE a IN (FROM n1) QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 50))
SELECT e AS entity_id, CAST(depth AS BIGINT) AS depth FROM (SELECT * FROM s1 UNION ALL SELECT b, 2 FROM n2 WHERE b NOT IN (SELECT e FROM s1)) ORDER BY depth, e LIMIT 50""")
def entity_relation_walk(spark, sf_dir):
    p = Pack.derive(spark, sf_dir)
    both = graph.either_way(p.entity_relation)
    mode = graph.resolve_mode("auto", p.entity_relation)
    assert mode == "relation"
    return graph.entity_walk(lambda frontier: both.join(frontier, "a"), "region-1", 2, 50, spark=spark)


@query(f"""WITH {_HE}, nodes AS (SELECT e FROM ({_walk_sql(50, 1).replace('WITH ' + _HE + ', ', 'WITH ')}) w(e, depth))
SELECT a.e AS source, b.e AS target, 'co_occurs' AS relation, count(DISTINCT article) AS weight FROM he a JOIN he b USING (article) WHERE a.e < b.e AND a.e IN (FROM nodes) AND b.e IN (FROM nodes) GROUP BY a.e, b.e""")
def entity_edges_weighted(spark, sf_dir):
    p = Pack.derive(spark, sf_dir)
    return graph.co_occurrence_edges(p.has_entity, _walk(1)(spark, sf_dir))


@query(f"WITH {_REL} SELECT t AS entity_id, count(*) AS in_degree FROM rel GROUP BY t")
def entity_in_degree(spark, sf_dir):
    return Pack.derive(spark, sf_dir).entity_relation.groupBy(F.col("target").alias("entity_id")).agg(F.count(F.lit(1)).alias("in_degree"))


_CRAWL_LINKS = "pl AS (SELECT src AS page, unnest([1, 2]) AS idx, unnest([(src * 7 + 3) % (n + 20), (src * 13 + 5) % (n + 20)]) AS target FROM (SELECT page_id AS src FROM pages), (SELECT count(*) AS n FROM pages))"


def crawl_links(pages: DataFrame) -> DataFrame:
    """Two links from each page, some of them to pages that are not there."""
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    made = F.posexplode(F.array((F.col("page") * 7 + 3) % (F.col("n") + 20), (F.col("page") * 13 + 5) % (F.col("n") + 20)))
    return pages.join(F.broadcast(n)).select("page", made.alias("p", "target")).select("page", (F.col("p") + 1).alias("index"), "target")


@query(f"""WITH {_CRAWL_LINKS}, s0 AS (SELECT page, idx AS turn, 0 AS depth FROM (SELECT unnest([2, 7, 11]) AS page, unnest([0, 1, 2]) AS idx) WHERE page IN (SELECT page_id FROM pages)),
l1 AS (SELECT target AS page, min((turn, pl.idx)) AS o FROM s0 JOIN pl ON pl.page = s0.page GROUP BY target),
s1 AS (SELECT page, row_number() OVER (ORDER BY o) AS turn, 1 AS depth FROM l1 WHERE page IN (SELECT page_id FROM pages) AND page NOT IN (SELECT page FROM s0)),
l2 AS (SELECT target AS page, min((turn, pl.idx)) AS o FROM s1 JOIN pl ON pl.page = s1.page GROUP BY target),
s2 AS (SELECT page, row_number() OVER (ORDER BY o) AS turn, 2 AS depth FROM l2 WHERE page IN (SELECT page_id FROM pages) AND page NOT IN (SELECT page FROM s0) AND page NOT IN (SELECT page FROM s1))
SELECT page, CAST(depth AS BIGINT) AS depth, row_number() OVER (ORDER BY depth, turn) AS position FROM (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2) QUALIFY position <= 12""")
def bounded_crawl(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("page"))
    links = crawl_links(pages)
    seeds = spark.createDataFrame([(2, 0), (7, 1), (11, 2)], "page bigint, index bigint")
    return graph.crawl(pages, links, seeds, 2, 12)
