"""Catalogue, text, incremental, evaluation and streaming queries, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphlore.functions import text, versions
from graphlore.operators import catalogue, evaluate, graph, incremental, records, vectors
from graphlore.plans import guard
from graphlore.plans.digests import tree_sql
from graphlore.plans.registry import query
from graphlore.plans.retrieval_queries import _STRIP, PACK, VECTORS, _near
from graphlore.sources.pack import Pack
from graphlore.streaming import events

ARTICLES = """art AS (SELECT 'doc-' || doc_id AS title, lang AS category, doc_id % 4 AS expansion_depth, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 0
  ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS word_count, text FROM documents)"""


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query("SELECT lang AS category, count(*) AS articles FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def category_counts(spark, sf_dir):
    return catalogue.category_counts(Pack.derive(spark, sf_dir).article)


@query("SELECT doc_id % 4 AS expansion_depth, count(*) AS articles FROM documents GROUP BY 1")
def depth_histogram(spark, sf_dir):
    return catalogue.depth_histogram(Pack.derive(spark, sf_dir).article)


@query(f"""WITH {PACK}, c AS (SELECT 'articles' AS metric, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'sections', count(*) FROM section UNION ALL SELECT 'links', count(*) FROM links
UNION ALL SELECT 'mentions', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
SELECT * FROM c UNION ALL SELECT 'avg_' || metric || '_per_article', floor(value / (SELECT value FROM c WHERE metric = 'articles') * 10 + 0.5) / 10 FROM c WHERE metric IN ('sections', 'links')""")
def corpus_stats(spark, sf_dir):
    p = Pack.derive(spark, sf_dir)
    return catalogue.corpus_stats({"articles": p.article, "sections": p.section, "links": p.links_to, "mentions": p.has_entity}, ["sections", "links"])


@query(f"WITH {PACK} SELECT article, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS summary FROM section WHERE content <> ''")
def article_summaries(spark, sf_dir):
    return catalogue.summaries(Pack.derive(spark, sf_dir).section)


@query("SELECT title, tier FROM (SELECT 'doc-' || doc_id AS title, CASE WHEN starts_with('doc-' || doc_id, 'doc-7') THEN 0 WHEN contains('doc-' || doc_id, 'doc-7') THEN 1 END AS tier FROM documents) WHERE tier IS NOT NULL ORDER BY tier, title LIMIT 10")
def autocomplete(spark, sf_dir):
    return catalogue.autocomplete(Pack.derive(spark, sf_dir).article.select("title"), "DOC-7")


@query("SELECT title, tier FROM (SELECT p_partkey || ' ' || p_name AS title, CASE WHEN starts_with(p_partkey || ' ' || p_name, '17') THEN 0 WHEN contains(p_partkey || ' ' || p_name, '17') THEN 1 END AS tier FROM part) WHERE tier IS NOT NULL ORDER BY tier, title LIMIT 20")
def autocomplete_two_tiers(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat("p_partkey", F.lit(" "), "p_name").alias("title"))
    return catalogue.autocomplete(parts, "17", 20)


@query(f"""WITH {PACK}, {ARTICLES}, pairs AS (SELECT DISTINCT a.article AS source, b.article AS target FROM links JOIN section a ON a.id = src JOIN section b ON b.id = dst)
SELECT title, category, word_count, (SELECT count(*) FROM section WHERE article = 'doc-5') AS n_sections, (SELECT sum(length(content))::BIGINT FROM section WHERE article = 'doc-5') AS n_chars,
  (SELECT coalesce(string_agg(target, '|' ORDER BY target), '') FROM pairs WHERE source = 'doc-5') AS links, (SELECT coalesce(string_agg(source, '|' ORDER BY source), '') FROM pairs WHERE target = 'doc-5') AS backlinks
FROM art WHERE title = 'doc-5'""")
def article_detail(spark, sf_dir):
    p = Pack.derive(spark, sf_dir)
    return catalogue.details(p.article, p.section, graph.article_links(p.section, p.links_to), "doc-5")


@query(f"WITH {PACK}, {_near('section', 9, 10)} SELECT article, row_number() OVER (ORDER BY min(r)) AS position FROM near JOIN section USING (id) GROUP BY article")
def chat_sources(spark, sf_dir):
    s = Pack.derive(spark, sf_dir).section
    return catalogue.chat_sources(vectors.vector_retrieve(s, vectors.vector_of(s, 9), 10), s)


@query("""WITH c AS (SELECT conv_id, turn, least(length(coalesce(text, '')), 800) AS used, count(*) OVER w AS n, sum(least(length(coalesce(text, '')), 800)) OVER w AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn AS position, used, chars::BIGINT AS chars FROM c WHERE n <= 50 AND chars <= 2000""")
def context_budget(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").alias("position"), F.coalesce("text", F.lit("")).alias("text"))
    return catalogue.bounded_context(rows, "conv_id", 50, 800, 2000)


@query(f"""WITH t AS (SELECT doc_id, {_STRIP('chr(9) || chr(10) || text || chr(160) || chr(13)')} AS t FROM documents), n AS (SELECT doc_id, t, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 512 THEN 1 ELSE ceil((length(t) - 512) / 448.0)::INT + 1 END AS n FROM t)
SELECT 'doc-' || doc_id || '#0#' || k AS chunk_id, length(substring(t, k * 448 + 1, 512)) AS chars, sha256(substring(t, k * 448 + 1, 512)) AS digest FROM (SELECT doc_id, t, unnest(range(0, n)) AS k FROM n)""")
def chunk_windows(spark, sf_dir):
    made = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.windows(F.concat(F.lit("\t\n"), "text", F.lit("\u00a0\r")))).alias("k", "w"))
    return made.select(F.concat(F.lit("doc-"), "doc_id", F.lit("#0#"), "k").alias("chunk_id"), F.length("w").cast("bigint").alias("chars"), F.sha2("w", 256).alias("digest"))


@query(f"WITH {ARTICLES} SELECT title, word_count FROM art")
def word_counts(spark, sf_dir):
    return Pack.derive(spark, sf_dir).article.select("title", "word_count")


def _entities_sql(x: str) -> str:
    # exact where the only references are named ones of the list and none makes another
    for name, char in text.ENTITIES.items():
        if name != "amp":
            x = f"regexp_replace({x}, '(?i)&{name};', '{char.replace(chr(39), chr(39) * 2)}', 'g')"
    return f"regexp_replace({x}, '(?i)&amp;', '&', 'g')"


def _clean_sql(x: str) -> str:
    return "trim(regexp_replace({}, '\\s+', ' ', 'g'))".format(_entities_sql(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"))


def _chrome_sql(x: str) -> str:
    # one alternation for each element, as there are no back-references; none of these is nested in another here but title in head
    for tag in ("script", "style", "nav", "footer", "header", "noscript", "head", "title"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return x


_BLOCK_SQL = "(?i)</?(" + "|".join(text.BLOCKS) + ")\\b[^>]*>"
_HEADS = [f"(?is)<h{k}\\b[^>]*>(.*?)</h{k}>" for k in range(1, 7)]


def _text_sql(x: str, mark: str) -> str:
    x = _chrome_sql(x)
    for k, pattern in enumerate(_HEADS, 1):
        x = f"regexp_replace({x}, '{pattern}', {mark.format(k=k)}, 'g')"
    return f"regexp_replace({x}, '{_BLOCK_SQL}', chr(10), 'g')"


@query("SELECT page_id, sha256(" + _clean_sql(_text_sql("html", "chr(10) || '\\1' || chr(10)")) + ") AS digest, length(" + _clean_sql(_text_sql("html", "chr(10) || '\\1' || chr(10)")) + ") AS chars FROM pages")
def html_strip_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.html_text(F.col("html")).alias("t")).select("page_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("bigint").alias("chars"))


_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


_URL_TITLE = f"""trim(regexp_replace(url_decode(CASE WHEN regexp_extract({_PATH}, '([^/]+)/*$', 1) = '' THEN {_HOST} ELSE regexp_extract({_PATH}, '([^/]+)/*$', 1) END), '[-_]', ' ', 'g'))"""


@query(f"""SELECT page_id, CASE WHEN t <> '' THEN t ELSE {_URL_TITLE} END AS title FROM (
SELECT page_id, url, trim(regexp_extract({_clean_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '^([^|–—]*)', 1)) AS t FROM pages)""")
def html_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.html_title(F.col("html"), F.col("url")).alias("title"))


@query(f"SELECT page_id, {_URL_TITLE} AS title FROM pages")
def url_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.url_title(F.col("url")).alias("title"))


_MARKED = "unnest(string_split(" + _text_sql("html", "chr(10) || chr(30) || '{k}' || chr(31) || '\\1' || chr(10)") + ", chr(10)))"


@query(f"""WITH marked AS (SELECT page_id, string_split({_text_sql("html", "chr(10) || chr(30) || '{k}' || chr(31) || '\\1' || chr(10)")}, chr(10)) AS ls FROM pages),
lines AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM marked),
kinds AS (SELECT page_id, pos, starts_with(line, chr(30)) AS head, CASE WHEN starts_with(line, chr(30)) THEN substring(line, 2, 1)::BIGINT ELSE 0 END AS level, CASE WHEN starts_with(line, chr(30)) THEN substring(line, 4) ELSE line END AS raw FROM lines),
clean AS (SELECT page_id, pos, head, level, {_clean_sql('raw')} AS line, sum(head::INT) OVER (PARTITION BY page_id ORDER BY pos) AS s FROM kinds),
made AS (SELECT page_id, s, max(level) AS level, coalesce(max(line) FILTER (head), '') AS title, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head AND line <> ''), '') AS content FROM clean GROUP BY page_id, s)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY s) - 1 AS section_index, level, title, content FROM made WHERE s = 0 OR title <> '' AND content <> ''""")
def html_sections(spark, sf_dir):
    return text.sections(_pages(spark, sf_dir), "page_id")


@query(f"""WITH a AS (SELECT page_id, url, {_HOST} AS host, regexp_extract_all(html, '(?i)<a\\b[^>]*?href\\s*=\\s*["'']([^"'']+)["'']', 1) AS hrefs FROM pages WHERE starts_with(url, 'https:')),
b AS (SELECT page_id, host, trim(unnest(hrefs)) AS href, generate_subscripts(hrefs, 1) AS i FROM a),
c AS (SELECT page_id, regexp_replace(CASE WHEN starts_with(href, '/') THEN 'https://' || host || href ELSE href END, '#.*$', '') AS link, min(i) AS i FROM b WHERE href <> '' AND NOT starts_with(href, '#') AND (starts_with(href, '/') OR starts_with(href, 'https://' || host || '/')) GROUP BY ALL)
SELECT pages.page_id, coalesce(string_agg(link, ' ' ORDER BY i), '') AS links FROM pages LEFT JOIN c USING (page_id) GROUP BY pages.page_id""")
def html_links(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.array_join(text.links(F.col("html"), F.col("url")), " ").alias("links"))


@query(f"SELECT page_id, starts_with(lower(url), 'https://') AND {_HOST} <> '' AND NOT contains(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '@') AS allowed FROM pages")
def url_gate(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text.url_allowed(F.col("url")).alias("allowed"))


_IPS = [(a, b, c) for a in (0, 1, 9, 10, 100, 127, 128, 169, 172, 192, 198, 203, 223, 224, 255) for b in (0, 16, 18, 31, 32, 51, 63, 64, 127, 168, 254) for c in (0, 2, 100, 113)]


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 256)::VARCHAR || '.' || (l_partkey % 256) || '.' || (l_suppkey % 256) || '.' || l_linenumber AS ip, l_orderkey % 256 AS a, l_partkey % 256 AS b, l_suppkey % 256 AS c FROM lineitem)
SELECT ip, count(*) AS requests, bool_or(a IN (0, 10, 127) OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 100 AND b BETWEEN 64 AND 127 OR a = 192 AND b = 0 AND c IN (0, 2)
  OR a = 198 AND b IN (18, 19) OR a = 198 AND b = 51 AND c = 100 OR a = 203 AND b = 0 AND c = 113 OR a >= 224) AS blocked FROM a GROUP BY ip""")
def ipv4_block_list(spark, sf_dir):
    n = lambda c: (F.col(c) % 256).cast("string")
    ips = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat_ws(".", n("l_orderkey"), n("l_partkey"), n("l_suppkey"), F.col("l_linenumber").cast("string")).alias("ip"))
    return ips.groupBy("ip").agg(F.count(F.lit(1)).alias("requests")).withColumn("blocked", text.ipv4_blocked(F.col("ip")))


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN 64512 + l_partkey % 1024 WHEN 1 THEN 8192 + l_orderkey % 4096 WHEN 2 THEN 8193 ELSE 0 END AS g0, CASE WHEN l_linenumber % 4 = 2 THEN 3510 + l_partkey % 4 ELSE 0 END AS g1, l_suppkey AS s FROM lineitem)
SELECT CASE WHEN n % 4 = 3 THEN '::ffff:' || (s % 256) || '.' || (k % 256) || '.3.4' ELSE lower(printf('%x', g0)) || ':' || lower(printf('%x', g1)) || '::' || lower(printf('%x', s % 65536)) END AS ip,
  CASE WHEN n % 4 = 3 THEN s % 256 IN (0, 10, 127) OR s % 256 >= 224 OR s % 256 = 169 AND k % 256 = 254 OR s % 256 = 192 AND k % 256 = 168 OR s % 256 = 172 AND k % 256 BETWEEN 16 AND 31 OR s % 256 = 100 AND k % 256 BETWEEN 64 AND 127
    OR s % 256 = 198 AND k % 256 IN (18, 19) ELSE g0 BETWEEN 65152 AND 65279 OR g0 BETWEEN 64512 AND 65023 OR g0 >= 65280 OR g0 = 8193 AND g1 = 3512 END AS blocked, count(*) AS requests FROM a GROUP BY 1, 2""")
def address_gate(spark, sf_dir):
    """IPv6 addresses from around the reserved ranges, and IPv4 inside IPv6."""
    h = lambda x: F.lower(F.hex(x))
    n = F.col("l_linenumber") % 4
    first = F.when(n == 0, 64512 + F.col("l_partkey") % 1024).when(n == 1, 8192 + F.col("l_orderkey") % 4096).otherwise(F.lit(8193))
    second = F.when(n == 2, 3510 + F.col("l_partkey") % 4).otherwise(F.lit(0))
    six = F.concat(h(first), F.lit(":"), h(second), F.lit("::"), h(F.col("l_suppkey") % 65536))
    four = F.concat(F.lit("::ffff:"), F.col("l_suppkey") % 256, F.lit("."), F.col("l_orderkey") % 256, F.lit(".3.4"))
    ips = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.when(n == 3, four).otherwise(six).alias("ip"))
    return ips.groupBy("ip").agg(F.count(F.lit(1)).alias("requests")).withColumn("blocked", text.ip_blocked_column(F.col("ip")))


_SYN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.SYNONYMS.items()) + "}"
_VERBS = ["\tFound\n", "\u00a0built-on", "Located In", "DEPENDS  on", "part_of", "belongs-to", "mentions"]
_VERB_SQL = "[" + ", ".join(f"'{v}'" for v in _VERBS) + "]"


_PHRASE = r"[A-Za-zÀ-ÿ]+[\s-]+[A-Za-zÀ-ÿ]+"


@query(f"""WITH raw AS (SELECT {_VERB_SQL}[event_id % 7 + 1] AS verb FROM events UNION ALL SELECT regexp_extract(text, '{_PHRASE}') FROM documents WHERE text IS NOT NULL),
v AS (SELECT regexp_replace(lower({_STRIP('verb')}), '[\\s-]+', '_', 'g') AS x FROM raw)
SELECT CASE WHEN x IN ({', '.join(f"'{r}'" for r in text.RELATIONS)}) THEN x ELSE coalesce(({_SYN})[x], x) END AS relation, count(*) AS mentions FROM v GROUP BY 1""")
def relation_normalize(spark, sf_dir):
    """Verbs with synonyms, and the first two words of every document as a verb that has none."""
    verbs = F.array(*[F.lit(v) for v in _VERBS])
    said = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.get(verbs, (F.col("event_id") % 7).cast("int")).alias("verb"))
    said = said.unionByName(_docs(spark, sf_dir).filter("text is not null").select(F.regexp_extract("text", _PHRASE, 0).alias("verb")))
    rows = said.select(text.relation(F.col("verb")).alias("relation"))
    return rows.groupBy("relation").agg(F.count(F.lit(1)).alias("mentions"))


@query("""WITH p AS (SELECT DISTINCT p_brand AS id FROM part), a AS (SELECT item_id, replace(text, ' the ', ' Brand#1 ') || ' Brand#12 Brand#3.' AS t FROM benchmark),
m AS (SELECT item_id, id, list_filter(range(1, length(t) - length(id) + 2), lambda i: substring(t, i, length(id)) = id AND NOT regexp_matches(substring(t, i + length(id), 1), '[A-Za-z0-9_#]')) AS places FROM a, p)
SELECT item_id, string_agg(id, ',' ORDER BY places[1], id) AS cited FROM m WHERE len(places) > 0 GROUP BY item_id""")
def cited_ids(spark, sf_dir):
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("id")).distinct()
    answers = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.concat(F.replace("text", F.lit(" the "), F.lit(" Brand#1 ")), F.lit(" Brand#12 Brand#3.")).alias("t"))
    # candidates come from the answer's own tokens, so answers are not paired with all identifiers
    tokens = answers.select("item_id", "t", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"Brand#\d+"), F.lit(0)))).alias("id"))
    found = tokens.join(brands, "id", "left_semi").withColumn("at", text.cites(F.col("t"), F.col("id"))).filter("at > 0")
    return found.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]), ",").alias("cited"))


@query("SELECT conv_id, turn, 'event: ' || role || chr(10) || 'data: ' || regexp_replace(text, '\\r\\n|\\r|\\n', chr(10) || 'data: ', 'g') || chr(10) || chr(10) AS frame FROM conversations")
def sse_frames(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", text.sse_frame(F.col("role"), F.col("text")).alias("frame"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN trim(text) WHEN 1 THEN '' WHEN 2 THEN 'x ```' || chr(10) || trim(text) ELSE trim(text) || chr(10) || '``` more' END AS body FROM benchmark")
def fence_strip(spark, sf_dir):
    """A fenced text, an empty fence, a fence that doesn't open the text, and one that doesn't close it."""
    kind, body = F.col("item_id") % 4, F.trim("text")
    fenced = F.when(kind == 0, F.concat(F.lit("\n```json\n"), body, F.lit("\n```\n"))).when(kind == 1, F.lit("```\n```")).when(kind == 2, F.concat(F.lit("x ```\n"), body)).otherwise(F.concat(F.lit("```\n"), body, F.lit("\n``` more")))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", text.strip_fence(fenced).alias("body"))


@query("SELECT item_id, trim(regexp_replace(replace(replace(text, 'than', '[redacted]'), 'the', '[redacted]'), '\\s+', ' ', 'g')) AS body FROM benchmark")
def redact_terms(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", text.collapse(text.redact(F.col("text"), ["the", "than", ""])).alias("body"))


@query("SELECT n_name, 'https://en.wikipedia.org/wiki/' || replace(replace(n_name || ' (a:b)/@ c', ' ', '_'), '+', '%2B') AS url FROM nation")
def wiki_urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", text.wiki_url(F.concat("n_name", F.lit(" (a:b)/@ c"))).alias("url"))


@query(f"""SELECT page_id, array_to_string(list_transform(list_filter(list_filter(string_split({_PATH}, '/'), lambda s: length(s) > 2)[1:3], lambda s: NOT lower(regexp_replace(s, '[-_]', ' ', 'g')) IN ({', '.join(f"'{x}'" for x in text.NO_CATEGORY)})),
  lambda s: upper(s[1]) || s[2:]), '|') AS categories FROM pages""")
def url_categories(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.array_join(text.categories(F.col("url")), "|").alias("categories"))


_BASE = "base AS (SELECT o_orderkey AS key, o_custkey || '|' || o_orderstatus || '|' || o_totalprice::DECIMAL(18, 2) || '|' || o_orderpriority AS payload FROM orders)"
_DELTA = """delta AS (SELECT o_orderkey AS key, o_custkey || '|' || o_orderstatus || '|' || (o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DECIMAL(18, 2) || '|' || o_orderpriority AS payload FROM orders
  UNION ALL SELECT o_orderkey + 100000000000, o_custkey || '|' || o_orderstatus || '|' || o_totalprice::DECIMAL(18, 2) || '|' || o_orderpriority FROM orders)"""


def _delta(spark, sf_dir):
    """Orders as the base; as the delta all of them again, finished ones at another price, and each once more under a new key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    payload = lambda price: F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", price.cast("decimal(18,2)").cast("string"), "o_orderpriority")
    base = o.select(F.col("o_orderkey").alias("key"), payload(F.col("o_totalprice")).alias("payload"))
    again = o.select(F.col("o_orderkey").alias("key"), payload(F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("payload"))
    new = o.select((F.col("o_orderkey") + 100000000000).alias("key"), payload(F.col("o_totalprice")).alias("payload"))
    return base, again.unionByName(new)


@query(f"WITH {_BASE}, {_DELTA} SELECT d.key, CASE WHEN b.key IS NULL THEN 'added' WHEN b.payload = d.payload THEN 'unchanged' ELSE 'modified' END AS classification FROM delta d LEFT JOIN base b USING (key)")
def delta_classify(spark, sf_dir):
    return incremental.classify(*_delta(spark, sf_dir))


@query(f"WITH {_BASE}, {_DELTA} SELECT CASE WHEN b.key IS NULL THEN 'added' WHEN b.payload = d.payload THEN 'unchanged' ELSE 'modified' END AS classification, count(*) AS records FROM delta d LEFT JOIN base b USING (key) GROUP BY 1")
def delta_counts(spark, sf_dir):
    return incremental.classify(*_delta(spark, sf_dir)).groupBy("classification").agg(F.count(F.lit(1)).alias("records"))


@query(f"WITH {_BASE}, {_DELTA} SELECT coalesce(d.key, b.key) AS key, coalesce(d.payload, b.payload) AS payload FROM base b FULL JOIN delta d ON b.key = d.key")
def delta_upsert(spark, sf_dir):
    return incremental.upsert(*_delta(spark, sf_dir))


_ROWS = """r AS (SELECT key::VARCHAR AS key, sha256('1' || chr(10) || '{"operation":"upsert","payload":"' || payload || '"}') AS h FROM delta)"""


@query(f"WITH {_BASE}, {_DELTA}, {_ROWS}, {tree_sql('r', 't')} SELECT digest AS delta_id, n::BIGINT AS rows FROM t_0")
def delta_identity(spark, sf_dir):
    _, delta = _delta(spark, sf_dir)
    return incremental.identity(delta.select(F.lit("upsert").alias("operation"), "key", "payload"))


@query("SELECT l_partkey AS part, count(*) AS relations FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def orphan_relations(spark, sf_dir):
    rel = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    good = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_acctbal > 0")
    return incremental.orphans(rel, "supplier", good, "s_suppkey").groupBy("part").agg(F.count(F.lit(1)).alias("relations"))


@query("SELECT c_custkey AS entity_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def orphan_entities(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("entity_id"))
    e = incremental.orphans(e, "entity_id", spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderpriority = '1-URGENT'"), "o_custkey")
    return incremental.orphans(e, "entity_id", spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity > 49"), "l_partkey")


@query("SELECT l_orderkey AS source, l_suppkey AS target FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def endpoint_filter(spark, sf_dir):
    edges = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target"))
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'")
    b = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_acctbal > 5000")
    return incremental.both_ends(incremental.both_ends(edges, a, "o_orderkey", ("source",)), b, "s_suppkey", ("target",))


@query("SELECT l_partkey AS entity_id, min(l_orderkey) AS seq, min_by(l_linenumber, (l_orderkey, l_linenumber, l_suppkey)) AS line, min_by(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS supplier FROM lineitem GROUP BY l_partkey")
def entity_first_wins(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"))
    return incremental.first_wins(rows, ["entity_id"], ["seq", "line"])


@query("SELECT user_id, event_type, count(*) AS times FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return incremental.duplicate_keys(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id", "event_type"])


@query("SELECT doc_id AS key, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'unexpected' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def source_closure(spark, sf_dir):
    return incremental.closure(_docs(spark, sf_dir).select(F.col("doc_id").alias("key")), spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("key")))


@query("""WITH g AS (SELECT vec_id AS k FROM embeddings), i AS (SELECT doc_id AS k FROM documents), e AS (SELECT k FROM i WHERE k <= (SELECT max(k) FROM g))
SELECT (SELECT count(*) FROM i) AS total, (SELECT count(*) FROM g) AS stored, (SELECT count(*) FROM e WHERE k IN (FROM g)) AS matching, (SELECT count(*) FROM e) = (SELECT count(*) FROM g) AND (SELECT count(*) FROM e WHERE k IN (FROM g)) = (SELECT count(*) FROM g) AS resumable""")
def prefix_resume(spark, sf_dir):
    return incremental.resume_point(_docs(spark, sf_dir).select(F.col("doc_id").alias("key")), spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("key")))


@query("""WITH q AS (SELECT doc_id AS id, lang AS pack, source AS skill FROM documents), s AS (SELECT pack, skill, min(id) AS skill_order FROM q GROUP BY ALL), p AS (SELECT pack, min(id) AS pack_order FROM q GROUP BY pack),
r AS (SELECT *, row_number() OVER (PARTITION BY pack, skill ORDER BY id) AS round FROM q) SELECT pack, skill, id, row_number() OVER (PARTITION BY pack ORDER BY round, skill_order) AS position, pack_order FROM r JOIN s USING (pack, skill) JOIN p USING (pack) QUALIFY position <= 25""")
def stratified_sample(spark, sf_dir):
    return evaluate.stratified(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("pack"), F.col("source").alias("skill")), 25)


def _arms(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("correct"), F.col("quality").cast("double").alias("score")), labels.select(F.col("doc_id").alias("id"), (F.col("toxic") == 0).alias("correct"), (1.0 - F.col("toxic")).alias("score"))


@query("""WITH v AS (SELECT 'pack' AS arm, quality = 1 AS correct, quality::DOUBLE AS score FROM labels UNION ALL SELECT 'baseline', toxic = 0, 1.0 - toxic FROM labels)
SELECT arm, count(*) AS questions, count(*) FILTER (correct) AS correct, count(*) FILTER (correct) / count(*) AS accuracy, avg(score) AS mean_score FROM v GROUP BY arm""")
def arm_metrics(spark, sf_dir):
    a, b = _arms(spark, sf_dir)
    return evaluate.arm_metrics(a.withColumn("arm", F.lit("pack")).unionByName(b.withColumn("arm", F.lit("baseline"))))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic <> 0) AS wins, count(*) FILTER (toxic = 0 AND quality <> 1) AS losses, count(*) FILTER ((quality = 1) = (toxic = 0)) AS ties FROM labels)
SELECT *, CASE WHEN wins + losses > 0 THEN wins / (wins + losses) ELSE 0.0 END AS win_rate FROM c""")
def compare_arms(spark, sf_dir):
    return evaluate.compare_arms(*_arms(spark, sf_dir))


@query("SELECT role, count(*) AS calls, sum(length(role))::BIGINT AS input, sum(length(text))::BIGINT AS output FROM conversations GROUP BY role")
def usage_totals(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", F.length("role").cast("bigint").alias("input"), F.length("text").cast("bigint").alias("output"))
    return evaluate.usage(rows, ["role"])


@query("""SELECT turn, count(*) AS verdicts, count(*) FILTER (conv_id % 3 = 0) AS correct, round(avg(CASE WHEN conv_id % 3 = 2 THEN 0.0 ELSE greatest(0, least(1, (conv_id % 15) / 10.0)) END), 6) AS mean_score FROM conversations GROUP BY turn""")
def verdict_parse(spark, sf_dir):
    good = F.to_json(F.struct((F.col("conv_id") % 3 == 0).alias("correct"), ((F.col("conv_id") % 15) / 10.0).alias("score"), F.col("text").alias("reasoning")))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("turn", evaluate.verdict(F.when(F.col("conv_id") % 3 == 2, F.lit("not json")).otherwise(good)).alias("v"))
    return rows.groupBy("turn").agg(F.count(F.lit(1)).alias("verdicts"), F.count_if("v.correct").alias("correct"), F.round(F.avg("v.score"), 6).alias("mean_score"))


@query(f"""WITH {VECTORS} SELECT id, id % 4 <> 1 AS embedding_agrees, id % 4 <> 2 AS retrieved_agrees, true AS reranked_agrees, id % 4 <> 3 AS answer_agrees,
CASE id % 4 WHEN 1 THEN 'embedding' WHEN 2 THEN 'retrieved' WHEN 3 THEN 'answer' END AS first_difference FROM vecs""")
def stage_parity(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    row = lambda v, got, cites: e.select("id", v.alias("vector"), got.alias("retrieved"), F.array(F.col("id")).alias("reranked"), cites.alias("citations"), F.lit(7).alias("seed"))
    at = lambda k: F.col("id") % 4 == k
    golden = row(F.col("embedding"), F.array(F.col("id"), F.col("id") + 1), F.array(F.lit("a"), F.lit("b")))
    actual = row(F.when(at(1), F.reverse("embedding")).otherwise(F.col("embedding")), F.when(at(2), F.array(F.col("id") + 1, F.col("id"))).otherwise(F.array(F.col("id"), F.col("id") + 1)), F.when(at(3), F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"), F.lit("b"))))
    return evaluate.stage_parity(actual, golden)


_VERSION = "(o_orderkey % 3) || '.' || (o_custkey % 12) || '.' || (o_orderkey % 11)"


@query(f"""WITH v AS (SELECT o_orderpriority AS pack, o_orderkey % 3 AS a, o_custkey % 12 AS b, o_orderkey % 11 AS c, o_orderkey % 2 = 0 AS release FROM orders)
SELECT pack, arg_max(a || '.' || b || '.' || c || CASE WHEN release THEN '' ELSE '-rc.1' END, (a, b, c, release)) AS latest, count(*) AS versions FROM v GROUP BY pack""")
def semver_latest(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    v = F.concat_ws(".", (F.col("o_orderkey") % 3).cast("string"), (F.col("o_custkey") % 12).cast("string"), (F.col("o_orderkey") % 11).cast("string"))
    v = F.concat(v, F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("-rc.1"))
    rows = o.select(F.col("o_orderpriority").alias("pack"), v.alias("v"))
    return rows.groupBy("pack").agg(F.max(F.struct(versions.order_key(F.col("v")).alias("k"), "v")).alias("m"), F.count(F.lit(1)).alias("versions")).select("pack", F.col("m.v").alias("latest"), "versions")


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) BETWEEN 1 AND 12 THEN year(o_orderdate) || '.' || month(o_orderdate) || '.' || (o_orderkey % 5) END AS version FROM orders""")
def dated_versions(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = F.col("o_orderkey") % 5
    tag = F.concat(F.lit("pack-"), F.date_format("o_orderdate", "yyyy.MM"), F.when(n == 0, F.lit("")).otherwise(F.concat(F.lit("."), n.cast("string"))))
    return o.select("o_orderkey", versions.dated(tag).alias("version"))


_GENERATED = ["MATCH (a) RETURN a", "call show_tables()", "MATCH (a) SET a.x = 1", "MATCH (a) WHERE a.t = ''DROP me'' RETURN a", "MATCH (a)-[*1..3]->(b) RETURN b", "RETURN 1", "MATCH (a:Asset) RETURN a"]


@query("""SELECT event_type, count(*) AS queries, count(*) FILTER (event_id % 7 IN (0, 1, 3, 6)) AS allowed FROM events GROUP BY event_type""")
def read_only_guard(spark, sf_dir):
    texts = F.array(*[F.lit(x.replace("''", "'")) for x in _GENERATED])
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", guard.is_read(F.get(texts, (F.col("event_id") % 7).cast("int"))).alias("ok"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("queries"), F.count_if("ok").alias("allowed"))


@query("SELECT 'doc-' || doc_id AS title FROM documents WHERE 'doc-' || doc_id > 'doc-3' ORDER BY title LIMIT 256")
def keyset_page(spark, sf_dir):
    return Pack.derive(spark, sf_dir).article.select("title").filter(F.col("title") > "doc-3").orderBy("title").limit(256)


@query("SELECT o_orderkey AS key FROM orders ORDER BY key LIMIT 4096 OFFSET 1000")
def offset_page(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key")).orderBy("key").offset(1000).limit(4096)


@query("SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS start, count(*) AS requests, least(count(*), 2) AS allowed, count(*) - least(count(*), 2) AS refused FROM events GROUP BY ALL")
def rate_limit_windows(spark, sf_dir):
    """The minute windows of a stream over all events; complete counts, as all input is there."""
    stream = events.request_windows(events.events_stream(spark, sf_dir), 2)
    return events.drain(stream, "rate-limit", "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    return events.drain(events.first_events(events.events_stream(spark, sf_dir), ["user_id", "event_type"]), "first-events")


@query("SELECT doc_id, lower(hex(unhex(sha256(coalesce(text, ''))))) AS digest, CASE WHEN length(text) > 1500 THEN substring(text, 1, 1500) || '...' ELSE text END AS short FROM documents")
def truncate_digest(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), text.truncate(F.col("text"), 1500).alias("short"))


#: Records that a task parses: a small file holds many, of which each is long in the parsing.
RECORDS_A_TASK = 10_000


def record_lines(spark, sf_dir):
    """Vulnerability records made of the parts, as JSON lines, dealt to tasks of a bounded number of them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    part = part.repartition(max(1, -(-part.count() // RECORDS_A_TASK)), "p_partkey")
    s = lambda **f: F.struct(*[c.alias(k) for k, c in f.items()])
    x, lit = F.col, F.lit
    number = (x("p_partkey") + 10000).cast("string")
    meta = s(cveId=F.concat(lit("CVE-2020-"), number), state=F.when(x("p_partkey") % 17 == 0, "REJECTED").otherwise("PUBLISHED"), assignerShortName=lit("acme"), datePublished=lit("2020-05-06T07:08:09Z"))
    cna = s(
        title=F.when(x("p_partkey") % 5 == 0, "").otherwise(x("p_name")),
        descriptions=F.array(s(lang=lit("de"), value=lit("etwas")), s(lang=lit("en"), value=F.concat(x("p_name"), lit(" is "), x("p_type")))),
        affected=F.array(s(vendor=x("p_brand"), product=x("p_name"), packageName=lit("left-pad"), collectionURL=lit("https://registry.npmjs.org/"), purl=F.concat(lit("pkg:npm/pad@"), x("p_size"))), s(vendor=lit("n/a"), product=x("p_type"), packageName=lit("n/a"), collectionURL=lit(None).cast("string"), purl=lit(None).cast("string"))),
        problemTypes=F.array(s(descriptions=F.array(s(cweId=F.concat(lit("CWE-"), x("p_size")), description=F.concat(lit("CWE-"), x("p_size"), lit(": weak")))))),
        metrics=F.array(s(cvssV3_1=s(baseScore=lit(7.5), baseSeverity=lit("high"), vectorString=lit("AV:N")))),
    )
    return part.select(F.to_json(s(cveMetadata=meta, containers=s(cna=cna))).alias("value"))


@query("""WITH p AS (SELECT 'CVE-2020-' || (p_partkey + 10000) AS article, *, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS t FROM part WHERE p_partkey % 17 <> 0)
SELECT article, CASE WHEN t = '' THEN article ELSE t END AS title, CASE WHEN p_name = p_type THEN p_name ELSE p_name || '; ' || p_type END AS affected_products, 'registry.npmjs.org/left-pad; pad; left-pad' AS aliases, 'npm' AS ecosystems,
  CASE WHEN t = '' THEN '' ELSE t || chr(10) || chr(10) END || p_name || ' is ' || p_type || chr(10) || chr(10) || 'Affected: ' || p_brand || ' ' || p_name || '; ' || p_type || '.' || chr(10) || chr(10)
  || 'Package: left-pad; https://registry.npmjs.org/; pkg:npm/pad@' || p_size || '.' || chr(10) || chr(10) || 'Aliases: registry.npmjs.org/left-pad; pad; left-pad.' || chr(10) || chr(10)
  || 'Weaknesses: CWE-' || p_size || ' weak.' || chr(10) || chr(10) || 'Severity: HIGH (CVSS 7.5) AV:N.' || chr(10) || chr(10) || 'Published: 2020-05-06.' || chr(10) || chr(10) || 'Assigner: acme.' AS content FROM p""")
def record_articles(spark, sf_dir):
    return records.parse_records(record_lines(spark, sf_dir)).select("article", "title", "affected_products", "aliases", "ecosystems", "content")


@query("""WITH p AS (SELECT 'CVE-2020-' || (p_partkey + 10000) AS a, *, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS t FROM part WHERE p_partkey % 17 <> 0)
SELECT a AS source, 'CWE-' || p_size AS target, 'has_weakness' AS relation, 'weak' AS context FROM p UNION ALL SELECT a, p_name, 'affects', t FROM p UNION ALL SELECT a, p_type, 'affects', t FROM p UNION ALL SELECT p_name, p_brand, 'made_by', '' FROM p""")
def record_relations(spark, sf_dir):
    return records.parse_records(record_lines(spark, sf_dir)).select(F.explode("relationships").alias("x")).select("x.source", "x.target", "x.relation", "x.context")


@query("""SELECT conv_id, turn, conv_id % 4 <> 3 AS readable, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE 1 END::BIGINT AS n_entities, CASE WHEN conv_id % 4 = 3 THEN '' ELSE 'founded' END AS relations, CASE WHEN conv_id % 4 = 3 OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE 1 END::BIGINT AS n_facts FROM conversations""")
def extraction_sanitize(spark, sf_dir):
    x = F.col
    made = F.to_json(F.struct(
        F.array(F.struct(x("role").alias("name"), F.lit(" ").alias("type")), F.struct(F.lit("").alias("name"), F.lit("x").alias("type"))).alias("entities"),
        F.array(F.struct(F.lit(" a ").alias("source"), F.lit("b").alias("target"), F.lit("Set-Up").alias("relation")), F.struct(F.lit("").alias("source"), F.lit("b").alias("target"), F.lit("made").alias("relation"))).alias("relationships"),
        F.array(x("text"), F.lit(" ")).alias("key_facts"),
    ))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("answer", F.when(x("conv_id") % 4 == 3, "no json").otherwise(F.concat(F.lit("```json\n"), made, F.lit("\n```"))))
    done = records.parse_extraction(rows, "answer")
    return done.select("conv_id", "turn", "readable", F.size("entities").cast("bigint").alias("n_entities"), F.array_join(F.transform("relationships", lambda r: r["relation"]), ",").alias("relations"), F.size("key_facts").cast("bigint").alias("n_facts"))
