"""Queries on whole packs: graphs with their decoration, references, deltas, writing, JSON and gates, each with SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlore.functions import text
from graphlore.operators import catalogue, evaluate, fusion, graph, incremental, support
from graphlore.plans import guard, retrieval_queries
from graphlore.plans.catalogue_queries import _BASE, _DELTA, _delta
from graphlore.plans.registry import ORACLE_SQL, QUERIES, query
from graphlore.plans.retrieval_queries import _HE, _REL, PACK, _walk, _walk_sql
from graphlore.plans.shared import cut, fresh_path
from graphlore.sources.pack import Pack
from graphlore.streaming.writer import PackWriter

_ARTICLE_PAIRS = "pairs AS (SELECT DISTINCT a.article AS source, b.article AS target FROM links JOIN section a ON a.id = src JOIN section b ON b.id = dst)"


@query(f"WITH {_REL}, nodes AS (SELECT entity_id FROM ({ORACLE_SQL['entity_relation_walk']})) SELECT DISTINCT s AS source, t AS target, r AS relation, 1::BIGINT AS weight FROM rel WHERE s IN (FROM nodes) AND t IN (FROM nodes)")
def entity_relation_edges(spark, sf_dir):
    return graph.relation_edges(Pack.derive(spark, sf_dir).entity_relation, QUERIES["entity_relation_walk"](spark, sf_dir))


@query(f"WITH {_HE}, w AS (SELECT * FROM ({_walk_sql(50, 2)}) UNION ALL SELECT -1, 9) SELECT w.entity_id, w.depth, count(DISTINCT he.article) AS articles_count FROM w LEFT JOIN he ON he.e = w.entity_id GROUP BY ALL")
def entity_nodes_decorated(spark, sf_dir):
    """The nodes of a walk, and one that no article mentions."""
    nodes = _walk(2)(spark, sf_dir).unionByName(spark.createDataFrame([(-1, 9)], "entity_id bigint, depth bigint"))
    return graph.decorated(nodes, Pack.derive(spark, sf_dir).has_entity)


@query(f"""WITH {PACK}, {_ARTICLE_PAIRS}, art AS ({ORACLE_SQL['word_counts']})
SELECT title, word_count, 'https://en.wikipedia.org/wiki/doc-7' AS url, (SELECT string_agg('0:' || title || ':' || sha256(content), '|') FROM section WHERE article = 'doc-7') AS parts,
  (SELECT string_agg(target, '|' ORDER BY target) FROM pairs WHERE source = 'doc-7') AS links, (SELECT len(list(source ORDER BY source)) FROM pairs WHERE target = 'doc-7') AS n_backlinks FROM art WHERE title = 'doc-7'""")
def article_full_detail(spark, sf_dir):
    p = Pack.derive(spark, sf_dir)
    found = catalogue.full_details(p.article, p.section, graph.article_links(p.section, p.links_to), "doc-7")
    parts = F.array_join(F.transform("sections", lambda s: F.concat_ws(":", s["section_index"], s["heading"], F.sha2(s["content"], 256))), "|")
    return found.select("title", "word_count", "url", parts.alias("parts"), F.array_join("links", "|").alias("links"), F.size("backlinks").cast("bigint").alias("n_backlinks"))


@query(f"""SELECT CASE WHEN starts_with(metric, 'avg_') THEN 'rate' ELSE 'count' END AS kind, metric AS name, value FROM ({ORACLE_SQL['corpus_stats']})
UNION ALL SELECT 'category', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'depth', (doc_id % 4)::VARCHAR, count(*) FROM documents GROUP BY doc_id % 4""")
def corpus_stats_full(spark, sf_dir):
    p = Pack.derive(spark, sf_dir)
    return catalogue.full_stats({"articles": p.article, "sections": p.section, "links": p.links_to, "mentions": p.has_entity}, ["sections", "links"], p.article)


@query(f"""WITH s AS ({ORACLE_SQL['seed_semantic_search']}), a AS ({ORACLE_SQL['word_counts']}), t AS ({ORACLE_SQL['article_summaries']})
SELECT s.article, lang AS category, a.word_count, coalesce(t.summary, '') AS summary, s.similarity, s.rank FROM s JOIN a ON a.title = s.article JOIN documents ON 'doc-' || doc_id = s.article LEFT JOIN t ON t.article = s.article""")
def semantic_search_details(spark, sf_dir):
    p = Pack.derive(spark, sf_dir)
    return fusion.semantic_search(p.section, p.article, catalogue.summaries(p.section), "doc-3", 10, "en", 0.05).withColumn("similarity", F.round("similarity", 6))


@query("SELECT 'doc-' || doc_id AS title, lang AS category, url FROM documents JOIN pages ON doc_id = page_id")
def article_sources(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("doc-"), "page_id").alias("title"), "url")
    return catalogue.sourced(Pack.derive(spark, sf_dir).article.select("title", "category"), pages)


@query("""WITH d AS (SELECT 'order' AS reference, l_orderkey::VARCHAR AS value FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'part', l_partkey::VARCHAR FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
UNION ALL SELECT 'supplier', l_suppkey::VARCHAR FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))
SELECT reference, value, count(*) AS times FROM d GROUP BY ALL""")
def dangling_references(spark, sf_dir):
    read = lambda t, where=None: (lambda d: d if where is None else d.filter(where))(spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    rows = read("lineitem")
    found = incremental.dangling({
        "order": (rows, "l_orderkey", read("orders", "o_orderstatus <> 'P'"), "o_orderkey"), "part": (rows, "l_partkey", read("part", "p_size > 5"), "p_partkey"),
        "supplier": (rows, "l_suppkey", read("supplier", "s_acctbal > 0"), "s_suppkey"),
    })
    return found.groupBy("reference", "value").agg(F.count(F.lit(1)).alias("times"))


@query(f"WITH w AS ({ORACLE_SQL['bounded_crawl']}) SELECT page, depth, position, (SELECT count(*) FROM w WHERE depth = 0) AS seeds, (SELECT count(*) FROM w WHERE depth > 0) AS discovered FROM w WHERE depth > 0")
def source_discovery(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("page"))
    return graph.discover(pages, retrieval_queries.crawl_links(pages), spark.createDataFrame([(2, 0), (7, 1), (11, 2)], "page bigint, index bigint"), 2, 12)


@query(f"WITH h AS ({ORACLE_SQL['int8_hit_at_k']}), c AS (SELECT avg((toxic = 0)::INT) - avg(quality) AS change FROM labels) SELECT round(avg(hit_at_10), 9) AS mean_hit, round(any_value(change), 9) AS change, avg(hit_at_10) >= 0.98 AND any_value(change) >= -0.02 AS adopt FROM h, c")
def quantised_adoption(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    arm = lambda name, x: labels.agg(F.avg(x).alias("accuracy")).select(F.lit(name).alias("arm"), "accuracy")
    arms = arm("full", F.col("quality").cast("double")).unionByName(arm("small", (F.col("toxic") == 0).cast("double")))
    got = evaluate.adoption_gate(QUERIES["int8_hit_at_k"](spark, sf_dir).select(F.col("hit_at_10").alias("hit")), arms)
    return got.select(F.round("mean_hit", 9).alias("mean_hit"), F.round("change", 9).alias("change"), "adopt")


# JSON and dates ------------------------------------------------------------------------------------

#: What a list of an event's fields goes on with; fixed values.
_ENDS = ("]", ", 1]", ", null]", ', "x,\\"y"]', "", "}", ', ["z"]]')


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_type || '|' || user_id WHEN 3 THEN event_type || '|' || user_id || '|x,' || chr(34) || 'y' END AS items FROM events""")
def string_lists(spark, sf_dir):
    """JSON lists of each event's own fields; one with a number, a null or a list in it, and one that is no JSON, is none of strings."""
    end = F.get(F.array(*map(F.lit, _ENDS)), (F.col("event_id") % 7).cast("int"))
    json = F.concat(F.lit('["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"'), end)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(text.string_list(json), "|").alias("items"))


@query("SELECT conv_id, turn, 'Ask ' || role || ' {{answer}}: ' || coalesce(text, '') || ' (' || coalesce(text, '') || ') {{other}}.' AS prompt FROM conversations")
def template_fill(spark, sf_dir):
    """A value that holds a mark is not filled again; a mark without a value stays."""
    values = {"question": F.concat("role", F.lit(" {{answer}}")), "answer": F.col("text")}
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", text.fill("Ask {{question}}: {{answer}} ({{answer}}) {{other}}.", values).alias("prompt"))


@query("""WITH u AS (SELECT doc_id, 55040 + doc_id % 2560 AS a, 55040 + doc_id * 7 % 2560 AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN a BETWEEN 55296 AND 56319 THEN NOT b BETWEEN 56320 AND 57343 ELSE a BETWEEN 56320 AND 57343 OR b BETWEEN 55296 AND 57343 END AS rejected FROM u""")
def surrogate_check(spark, sf_dir):
    """Each document's text as JSON, then two escapes from around the range of surrogates, in pairs or alone."""
    code = lambda c: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.lit(55040) + c % 2560), 4, "0")))
    whole = F.to_json(F.struct(F.col("text").alias("t")))
    json = F.concat(F.substr(whole, F.lit(1), F.length(whole) - 2), code(F.col("doc_id")), code(F.col("doc_id") * 7), F.lit('"}'))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").select("doc_id", text.lone_surrogate(json).alias("rejected"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '{"a":[{"b":"' || o_orderstatus || '","y":' || o_custkey || '}],"z":' || o_orderkey || ',"é":null}' END AS canonical FROM orders""")
def canonical_records(spark, sf_dir):
    """Records with their keys in any order; those with a forbidden key, however deep, become null."""
    key = F.when(F.col("o_orderkey") % 5 == 0, F.lit("constructor")).otherwise(F.lit("y"))
    raw = F.concat(F.lit('{ "z": '), "o_orderkey", F.lit(', "é" : null, "a": [ {"'), key, F.lit('": '), "o_custkey", F.lit(', "b": "'), "o_orderstatus", F.lit('"} ]}'))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.safe_json(raw).alias("canonical"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 31 + 1 <= 28 OR o_orderkey % 31 + 1 <= 30 AND o_custkey % 12 + 1 <> 2 OR o_custkey % 12 + 1 IN (1, 3, 5, 7, 8, 10, 12) THEN make_date(2023, (o_custkey % 12 + 1)::INT, (o_orderkey % 31 + 1)::INT)::VARCHAR END AS day FROM orders""")
def tag_dates(spark, sf_dir):
    tag = F.format_string("pack-2023-%02d-%02d.1", F.col("o_custkey") % 12 + 1, F.col("o_orderkey") % 31 + 1)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.tag_date(tag).cast("string").alias("day"))


# deltas and writing --------------------------------------------------------------------------------

@query(f"WITH {_BASE}, {_DELTA} SELECT coalesce(d.key, b.key) AS key, coalesce(d.payload, b.payload) AS payload, CASE WHEN b.payload IS NOT NULL AND (d.payload IS NULL OR b.payload = d.payload) THEN -1.0::DOUBLE ELSE length(d.payload)::DOUBLE END AS first_value, b.payload IS NOT NULL AND (d.payload IS NULL OR b.payload = d.payload) AS reused FROM base b FULL JOIN delta d ON b.key = d.key")
def delta_recompute(spark, sf_dir):
    """Vectors of unchanged rows are the base's, which no embedding of their payloads would give."""
    base, delta = _delta(spark, sf_dir)
    base = base.withColumn("embedding", F.array(F.lit(-1.0), (F.col("key") % 7).cast("double")))
    return incremental.recompute(base, delta, lambda rows: rows.withColumn("embedding", F.array(F.length("payload").cast("double"), F.lit(1.0)))).select("key", "payload", F.col("embedding")[0].alias("first_value"), "reused")


@query(f"SELECT delta_id, sha256('pack=orders' || chr(10) || 'version=1.2.0' || chr(10) || 'base=b0' || chr(10) || 'model=small' || chr(10) || 'builder=3' || chr(10) || 'schema=2' || chr(10) || 'delta=' || delta_id) AS build_id FROM ({ORACLE_SQL['delta_identity']})")
def delta_build_identity(spark, sf_dir):
    return incremental.build_identity(QUERIES["delta_identity"](spark, sf_dir), "orders", "1.2.0", "b0", "small", {"schema": "2", "builder": "3"})


_CHECKED = f"""{PACK}, article AS (SELECT 'doc-' || doc_id AS title, text FROM documents), he AS (SELECT 'doc-' || (l_orderkey % 500) AS article, l_partkey AS entity_id FROM lineitem),
entity AS (SELECT p_partkey AS entity_id FROM part WHERE p_size > 3), rel AS (SELECT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_linenumber = 1)"""
_COUNT = "SELECT '{}' AS check_name, count(*) AS violations FROM {}".format


@query(f"WITH {_CHECKED} " + " UNION ALL ".join([
    _COUNT("article title repeated", "(SELECT title FROM article GROUP BY 1 HAVING count(*) > 1)"), _COUNT("section id repeated", "(SELECT id FROM section GROUP BY 1 HAVING count(*) > 1)"),
    _COUNT("entity id repeated", "(SELECT entity_id FROM entity GROUP BY 1 HAVING count(*) > 1)"), _COUNT("section without article", "section WHERE article NOT IN (SELECT title FROM article)"),
    _COUNT("article without section", "article WHERE title NOT IN (SELECT article FROM section)"), _COUNT("link from nowhere", "links WHERE src NOT IN (SELECT id FROM section)"),
    _COUNT("link to nowhere", "links WHERE dst NOT IN (SELECT id FROM section)"), _COUNT("mention in no article", "he WHERE article NOT IN (SELECT title FROM article)"),
    _COUNT("mention of no entity", "he WHERE entity_id NOT IN (SELECT entity_id FROM entity)"), _COUNT("relation from nowhere", "rel WHERE source NOT IN (SELECT entity_id FROM entity)"),
    _COUNT("relation to nowhere", "rel WHERE target NOT IN (SELECT entity_id FROM entity)"), _COUNT("entity unused", "entity WHERE entity_id NOT IN (SELECT entity_id FROM he) AND entity_id NOT IN (SELECT source FROM rel) AND entity_id NOT IN (SELECT target FROM rel)"),
    _COUNT("embedding unsound", "section WHERE len(v) <> 64"), _COUNT("article without title", "article WHERE trim(title) = ''"), _COUNT("section without content", "section WHERE coalesce(trim(content), '') = ''"),
    _COUNT("sections not numbered from 0", "(SELECT article FROM section GROUP BY 1 HAVING count(*) > 1)"), _COUNT("link repeated", "(SELECT src, dst FROM links GROUP BY ALL HAVING count(*) > 1)"),
    _COUNT("link to itself", "links WHERE src = dst"), _COUNT("mention repeated", "(SELECT article, entity_id FROM he GROUP BY ALL HAVING count(*) > 1)"),
    _COUNT("relation repeated", "(SELECT source, target FROM rel GROUP BY ALL HAVING count(*) > 1)"), _COUNT("article differs from its source", "documents WHERE lang = 'fr'"),
]))
def pack_checks(spark, sf_dir):
    """Every check over a pack with faults: entities left out, mentions and relations repeated, French articles unlike what their texts give."""
    p = Pack.derive(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    he = rows.select(F.concat(F.lit("doc-"), F.col("l_orderkey") % 500).alias("article"), F.col("l_partkey").alias("entity_id"))
    entity = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size > 3").select(F.col("p_partkey").alias("entity_id"))
    relation = rows.filter("l_linenumber = 1").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.lit("supplied_by").alias("relation"))
    derived = p.article.select("title", "word_count", "category")
    stored = derived.withColumn("word_count", F.when(F.col("category") == "fr", F.col("word_count") + 1).otherwise(F.col("word_count")))
    return support.validate(p.article, p.section, p.links_to, he, entity, relation, 64, {"article": (stored, derived, "title")})


@query("""WITH a AS (SELECT o_orderkey AS k, 'order-' || o_orderkey AS title FROM orders), li AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem GROUP BY ALL),
e AS (SELECT l_partkey, arg_min(l_orderkey, (l_orderkey % 4, l_orderkey, n)) AS first_order FROM li GROUP BY 1),
all_keys AS (
  SELECT 'article' AS table_name, title AS key FROM a UNION ALL SELECT 'entity', l_partkey || ':' || first_order FROM e UNION ALL SELECT 'has_entity', l_orderkey || ':' || l_partkey FROM li
  UNION ALL SELECT 'links', s || '>' || t FROM (SELECT k AS s, k * 2 AS t FROM a WHERE k <> 0 AND k * 2 IN (SELECT k FROM a))
  UNION ALL SELECT 'entity_relation', s || '>' || t FROM (SELECT DISTINCT l_partkey AS s, l_partkey + 10 AS t FROM li WHERE l_partkey + 10 IN (SELECT l_partkey FROM li)))
SELECT table_name, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(key), 1, 12) AS HUGEINT)) AS VARCHAR) AS digest FROM all_keys GROUP BY table_name""")
def pack_writer(spark, sf_dir):
    """Orders written in four batches, one of them twice and by a writer that starts anew; links wait until all are there."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k"), "l_partkey").agg(F.min("l_linenumber").alias("n"))
    held = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", F.col("l_partkey").cast("string").alias("entity_id"), F.concat(F.lit("part "), "l_partkey").alias("name")))).alias("found"))
    related = F.transform("found", lambda x: F.struct(x["entity_id"].alias("source"), (x["entity_id"].cast("bigint") + 10).cast("string").alias("target"), F.lit("near").alias("relation")))
    named = F.transform("found", lambda x: F.struct(x["entity_id"].alias("entity_id"), x["name"].alias("name")))
    title = lambda c: F.concat(F.lit("order-"), c)
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    rows = o.join(held, "k", "left").select(
        title(F.col("k")).alias("title"), F.col("k").alias("position"), F.lit("").alias("content"), none(named, "array<struct<entity_id:string,name:string>>").alias("entities"),
        F.array(title(F.col("k") * 2)).alias("links"), none(related, "array<struct<source:string,target:string,relation:string>>").alias("relations"))
    folder = fresh_path(spark, "pack-writer")
    for turn in (0, 1, 1, 2, 3):
        PackWriter(spark, folder).write(rows.filter(F.col("position") % 4 == turn), turn)
    pack = PackWriter(spark, folder).finish()
    bare = lambda c: F.replace(c, F.lit("order-"), F.lit(""))
    keys = {
        "article": F.col("title"), "entity": F.concat_ws(":", "entity_id", bare("first_article")), "has_entity": F.concat_ws(":", bare("article"), "entity_id"),
        "links": F.concat_ws(">", bare("source"), bare("target")), "entity_relation": F.concat_ws(">", "source", "target"),
    }
    found = [spark.read.parquet(f"{pack}/{name}").select(F.lit(name).alias("table_name"), key.alias("key")) for name, key in keys.items()]
    # a sum of digests doesn't depend on order and gathers nothing; halves of 24 bits are summed as longs
    half = lambda at: F.sum(F.conv(F.substring(F.sha2("key", 256), at, 6), 16, 10).cast("bigint")).cast("decimal(30,0)")
    return reduce(DataFrame.unionByName, found).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), (half(1) * F.lit(1 << 24).cast("decimal(8,0)") + half(7)).cast("decimal(38,0)").cast("string").alias("digest"))


# relations by support --------------------------------------------------------------------------------

#: Orders as articles that state by whom parts are supplied and with which flag; a delta changes, removes and adds orders.
_STATED = """stated AS (SELECT DISTINCT l_orderkey AS article, 'part-' || l_partkey AS source, 'supplier-' || l_suppkey AS target, 'supplied_by' AS relation, coalesce(l_returnflag, '') AS context FROM lineitem WHERE l_orderkey % 10 <> 1),
fresh AS (
  SELECT DISTINCT l_orderkey AS article, 'part-' || l_partkey AS source, 'supplier-' || l_suppkey AS target, 'supplied_by' AS relation, CASE WHEN l_linenumber = 2 THEN 'CART' ELSE coalesce(l_returnflag, '') END AS context
  FROM lineitem WHERE l_orderkey % 10 = 1 OR l_orderkey % 10 = 2 AND l_linenumber > 1),
before AS (SELECT source, target, relation, context, count(*) AS n FROM stated GROUP BY ALL),
later AS (SELECT source, target, relation, context, count(*) AS n FROM (SELECT * FROM stated WHERE article % 10 NOT IN (2, 3) UNION ALL FROM fresh) GROUP BY ALL)"""


def _stated(spark, sf_dir):
    """Support before a delta, written once as its uses are many; the articles that it changes (last digit 2) or removes (3), and what those and new ones (1) state now."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    named = lambda kind, key: F.concat(F.lit(f"{kind}-"), key)
    stated = lambda where, context: support.supported(rows.filter(where).select(F.col("l_orderkey").alias("article"), named("part", "l_partkey").alias("source"), named("supplier", "l_suppkey").alias("target"), F.lit("supplied_by").alias("relation"), context.alias("context")))
    changed = rows.filter("l_orderkey % 10 IN (2, 3)").select(F.col("l_orderkey").alias("article"))
    moved = F.when(F.col("l_linenumber") == 2, F.lit("CART")).otherwise(F.col("l_returnflag"))
    return cut(stated("l_orderkey % 10 <> 1", F.col("l_returnflag")), "stated"), changed, stated("l_orderkey % 10 = 1 OR l_orderkey % 10 = 2 AND l_linenumber > 1", moved)


@query(f"WITH {_STATED} SELECT source, target, relation, context, n FROM later")
def relation_support_delta(spark, sf_dir):
    """Relations maintained by counts of support; the SQL builds them anew."""
    before, changed, fresh = _stated(spark, sf_dir)
    return support.applied(support.counts(before), before, changed, fresh)


@query(f"""WITH {_STATED}, touched AS (SELECT source, target, relation, context FROM stated WHERE article % 10 IN (2, 3) UNION SELECT source, target, relation, context FROM fresh)
SELECT source, target, relation, context, coalesce(before.n, 0) AS was, coalesce(later.n, 0) AS now FROM touched LEFT JOIN before USING (source, target, relation, context) LEFT JOIN later USING (source, target, relation, context)""")
def relation_support_changes(spark, sf_dir):
    before, changed, fresh = _stated(spark, sf_dir)
    return support.changes(support.counts(before), before, changed, fresh)


@query(f"""WITH {_STATED}, art AS (SELECT DISTINCT o_orderkey AS t FROM orders WHERE o_orderkey % 10 <> 4), wrong AS (SELECT o_orderkey AS t FROM orders WHERE o_orderkey % 7 = 0),
live AS (SELECT source, target, relation, context FROM stated WHERE context <> 'A' GROUP BY ALL UNION ALL SELECT 'part-0', 'supplier-0', 'supplied_by', '')
SELECT 'support of no article' AS check_name, count(*) AS violations FROM stated WHERE article NOT IN (FROM art)
UNION ALL SELECT 'support repeated', 0 UNION ALL SELECT 'relation without support', count(*) FROM (FROM live EXCEPT SELECT source, target, relation, context FROM stated)
UNION ALL SELECT 'support without relation', count(*) FROM (SELECT source, target, relation, context FROM stated EXCEPT FROM live)
UNION ALL SELECT 'source repeated', 0 UNION ALL SELECT 'source unlike its hash', count(*) FROM wrong UNION ALL SELECT 'source of no article', count(*) FROM orders WHERE o_orderkey % 10 = 4
UNION ALL SELECT 'article without source', 0 UNION ALL SELECT 'applied delta unlike its source', count(*) FROM wrong WHERE t % 2 = 0
UNION ALL SELECT 'chunk without section', count(*) FROM lineitem WHERE l_orderkey % 10 = 4 UNION ALL SELECT 'chunk without content', count(*) FROM lineitem WHERE coalesce(trim(l_returnflag), '') = ''
UNION ALL SELECT 'chunks not numbered from 0', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*))
UNION ALL SELECT 'chunk id repeated', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)""")
def support_checks(spark, sf_dir):
    """Checks of support, sources, chunks and applied deltas over a pack with faults in each."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    there = orders.filter("o_orderkey % 10 <> 4").select(F.col("o_orderkey").alias("title"))
    sections = there.select(F.col("title").alias("id"), F.col("title").alias("article"), F.lit(0).alias("section_index"), F.lit("x").alias("content"), F.array(F.lit(0.0)).alias("embedding"))
    before, _, _ = _stated(spark, sf_dir)
    live = before.filter("context <> 'A'").select(*support.RELATION).distinct().union(spark.range(1).select(F.lit("part-0"), F.lit("supplier-0"), F.lit("supplied_by"), F.lit("")))
    live = cut(live, "live")
    payload = F.concat_ws("|", "o_orderstatus", "o_orderkey")
    source = orders.select(F.col("o_orderkey").alias("title"), payload.alias("payload"), F.when(F.col("o_orderkey") % 7 != 0, F.sha2(payload, 256)).otherwise(F.lit("wrong")).alias("hash"))
    applied = orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("title"), F.sha2(payload, 256).alias("hash"))
    chunk = lines.select(F.concat_ws("#", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("article"), F.lit(0).alias("section_index"), (F.col("l_linenumber") - 1).alias("chunk_index"), F.col("l_returnflag").alias("content"))
    entity = lines.select(F.concat(F.lit("part-"), "l_partkey").alias("entity_id")).distinct()
    mentions = spark.createDataFrame([], "article bigint, entity_id string")
    found = support.validate(there, sections, sections.select(F.col("id").alias("src"), F.col("id").alias("dst")), mentions, entity, live, 1, support=before, source=source, chunk=chunk, applied=applied)
    names = ("support of no article", "support repeated", "relation without support", "support without relation", "source repeated", "source unlike its hash", "source of no article", "article without source",
             "applied delta unlike its source", "chunk without section", "chunk without content", "chunks not numbered from 0", "chunk id repeated")
    return found.filter(F.col("check_name").isin(*names))


_STATUSES = "SELECT o_orderstatus AS status, count(*) AS n_orders, max(o_totalprice) AS top FROM {} WHERE o_totalprice > {} GROUP BY o_orderstatus"


@query(_STATUSES.format("orders", 100000))
def statement_sequence(spark, sf_dir):
    """Statements in sequence, each of which only reads: the rows of the last, with a named parameter."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("graphlore_orders")
    sql = "SELECT count(*) FROM graphlore_orders; -- first the number; then the groups\n" + _STATUSES.format("graphlore_orders", ":least") + ";"
    return guard.run_reads(spark, sql, 100, tables={"graphlore_orders"}, args={"least": 100000})
