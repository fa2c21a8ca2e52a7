"""Known answers and invariants of the retrieval operators."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphlore.functions import text, versions
from graphlore.operators import catalogue, evaluate, fusion, graph, incremental, records, vectors
from graphlore.plans import guard
from graphlore.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def four(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.12, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0, 1.0])]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>")


def query(spark, v):
    return spark.createDataFrame([(v,)], "q array<float>")


def test_nearest(spark, four):
    got = vectors.knn(four, query(spark, [1.0, 0.05, 0.0, 0.0]), 4).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2, 3, 4]
    assert [round(r.similarity, 5) for r in got] == [0.99875, 0.99759, 0.04994, 0.0]
    assert vectors.knn(four, query(spark, [0.0] * 4), 4).agg(F.max("similarity")).first()[0] == 0.0
    with pytest.raises(ValueError):
        vectors.knn(four, query(spark, [1.0] * 4), 0)


def test_more_neighbours_keep_the_first(spark, four):
    q = query(spark, [0.3, 0.2, 0.1, 0.9])
    top = [[r.id for r in vectors.knn(four, q, k).orderBy("rank").collect()] for k in (1, 2, 3)]
    assert top[2][:2] == top[1] and top[1][:1] == top[0]


def test_quantised(spark):
    rows = spark.createDataFrame([([0.5, -1.0, 0.25],), ([0.0, 0.0, 0.0],)], "v array<float>")
    got = rows.select(vectors.quantize(F.col("v")).alias("c")).select("c.*", vectors.dequantize(F.col("c")).alias("w")).collect()
    assert list(got[0].codes) == [64, -127, 32] and got[1].scale == 0.0 and list(got[1].w) == [0.0] * 3


def hybrid(spark):
    sections = [(1, "Alpha", [1.0, 0.0]), (2, "Beta", [0.0, 1.0]), (3, "Gamma", [0.0, 1.0]), (4, "Delta", [0.0, 1.0])]
    return spark.createDataFrame(sections, "id bigint, title string, embedding array<float>"), spark.createDataFrame([(1, 2)], "src bigint, dst bigint")


def test_hybrid_arithmetic(spark):
    s, links = hybrid(spark)
    words = one(spark, fusion.keywords(F.lit("Alpha quantum theory")))
    got = {r.id: round(r.score, 6) for r in fusion.hybrid_retrieve(s, links, query(spark, [1.0, 0.0]), words, 4).collect()}
    assert got == {1: 0.64, 2: 0.15, 3: 0.0, 4: 0.0}  # 0.5 by vector and 0.14 by keyword; 0.15 by link
    off = {r.id: r.score for r in fusion.hybrid_retrieve(s, links, query(spark, [1.0, 0.0]), words, 4, (0.5, 0.3, 0.0)).collect()}
    assert round(off[1], 6) == 0.5


def test_repeated_links_add_again(spark):
    s, links = hybrid(spark)
    got = {r.id: round(r.score, 6) for r in fusion.hybrid_retrieve(s, links.union(links), query(spark, [1.0, 0.0]), [], 4).collect()}
    assert got[2] == 0.3


def test_keywords_and_terms(spark):
    assert one(spark, fusion.keywords(F.lit(" What  about the Graph store? store? and more things "))) == ["about", "Graph", "store?"]
    assert one(spark, fusion.lexical_terms(F.lit("Code.gitea.io/gitea a:b x"))) == ["code.gitea.io/gitea a:b x", "code.gitea.io", "gitea"]


def test_lexical(spark):
    rows = spark.createDataFrame([(1, "code.gitea.io/gitea", "go"), (2, "other", None), (3, "GITEA tea", "npm")], "id bigint, aliases string, ecosystems string")
    got = fusion.lexical_retrieve(rows, "code.gitea.io/gitea", ["aliases", "ecosystems"], 5).orderBy("rank").collect()
    assert [(r.id, round(r.score, 4)) for r in got] == [(1, 1.0), (3, round(1 / 3, 4))]
    with pytest.raises(ValueError, match="no columns"):
        fusion.lexical_retrieve(rows, "x", ["cpes"], 5)


def test_unions(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.9)], "id bigint, score double")
    b = spark.createDataFrame([(1, 0.5), (3, 0.1)], "id bigint, score double")
    assert {r.id: r.source for r in fusion.union_by_max(a, b).collect()} == {1: 0, 2: 0, 3: 1}
    assert {r.id: r.source for r in fusion.union_second_wins(a, b).collect()} == {1: 1, 2: 0, 3: 1}


def test_rerank_adds_no_rows(spark):
    c = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 2), (3, 0.49, 3)], "id bigint, score double, rank bigint")
    links = spark.createDataFrame([(3, 1), (1, 9)], "src bigint, dst bigint")
    got = fusion.graph_rerank(c, links).orderBy("rank").collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [(1, 0.9 + 0.49 / 4), (3, 0.49 + 0.9 / 4), (2, 0.5)]
    assert fusion.graph_rerank(c, links, hops=0) is c
    with pytest.raises(ValueError):
        fusion.graph_rerank(c, links, hops=2)


@pytest.fixture(scope="module")
def mentions(spark):
    rows = [("A", "CWE-79"), ("A", "WordPress"), ("B", "CWE-79"), ("B", "Drupal"), ("C", "WordPress"), ("C", "Acme")]
    kinds = [("CWE-79", "weakness"), ("WordPress", "product"), ("Drupal", "product"), ("Acme", "organization")]
    return spark.createDataFrame(rows, "article string, entity_id string"), spark.createDataFrame(kinds, "entity_id string, type string")


def test_entity_walk(spark, mentions):
    he, kinds = mentions
    walk = lambda depth, kind=None: {r.entity_id: r.depth for r in graph.entity_walk(lambda f: graph.co_occurrence(he, f), "CWE-79", depth, 50, kinds, kind, spark).collect()}
    assert walk(1) == {"CWE-79": 0, "Drupal": 1, "WordPress": 1}
    assert walk(2) == {"CWE-79": 0, "Drupal": 1, "WordPress": 1, "Acme": 2}
    assert walk(2, "organization") == {"CWE-79": 0}  # the type prunes the way, too
    edges = graph.co_occurrence_edges(he, graph.entity_walk(lambda f: graph.co_occurrence(he, f), "CWE-79", 1, 50, spark=spark)).collect()
    assert {(r.source, r.target): r.weight for r in edges} == {("CWE-79", "Drupal"): 1, ("CWE-79", "WordPress"): 1}
    with pytest.raises(ValueError):
        walk(4)


def test_reachable_at_least_depth(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (3, 1)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(1,)], "node bigint")
    assert {r.node: r.depth for r in graph.reachable(links, seeds, 3).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    with pytest.raises(ValueError):
        graph.reachable(links, seeds, 0)


def test_text_functions(spark):
    lit = lambda s: F.lit(s)
    assert one(spark, text.decode_entities(lit("a &amp;lt; &#233;&#x1F600; &nope; &#0; &"))) == "a &lt; é😀 &nope; &#0; &"
    html = "<html><head><title>T | Site</title></head><body><nav>no</nav><p>Lead</p><h2>One</h2><p>x<br>y</p><a href='/a#b'>l</a><a href='//evil/'>e</a></body></html>"
    assert one(spark, text.html_title(lit(html), lit("https://h/x"))) == "T"
    assert one(spark, text.html_text(lit(html))) == "Lead One x y l e"
    assert one(spark, text.links(lit(html), lit("https://h/x"))) == ["https://h/a"]
    assert one(spark, text.url_title(lit("https://en.wikipedia.org/wiki/Bell%27s_theorem"))) == "Bell's theorem"
    assert one(spark, text.url_title(lit("https://h.org/a/get-started_now/"))) == "get started now"
    assert one(spark, text.categories(lit("https://h.org/docs/azure-lab/x/vm"))) == ["Azure Lab"]
    assert one(spark, text.relation(lit(" Set-up "))) == "founded" and one(spark, text.relation(lit("likes"))) == "likes"
    assert one(spark, text.windows(lit("abcdefghij"), 4, 1)) == ["abcd", "defg", "ghij"]
    assert one(spark, text.windows(lit("  "), 4, 1)) == []
    assert one(spark, text.strip_fence(lit("```json\n{}\n```"))) == "{}" and one(spark, text.strip_fence(lit(" x "))) == "x"
    assert one(spark, text.sse_frame(lit("token"), lit("a\r\nb"))) == "event: token\ndata: a\ndata: b\n\n"
    assert one(spark, text.cites(lit("see CWE-79x, then CWE-79."), lit("CWE-79"))) == 19
    assert one(spark, text.cites(lit("nothing"), lit("CWE-79"))) == 0


def test_url_and_address_gates(spark):
    for url, ok in (("https://a.b/c", True), ("http://a.b", False), ("https://u:p@a.b", False), ("https:///x", False)):
        assert one(spark, text.url_allowed(F.lit(url))) is ok
    for ip, blocked in (("8.8.8.8", False), ("10.0.0.1", True), ("172.32.0.1", False), ("100.64.0.1", True), ("256.1.1.1", True), ("x", True)):
        assert one(spark, text.ipv4_blocked(F.lit(ip))) is blocked and text.ip_blocked(ip) is blocked
    assert text.ip_blocked("::ffff:10.0.0.1") and text.ip_blocked("fe80::1") and not text.ip_blocked("2606:4700::1") and not text.ip_blocked("::ffff:8.8.8.8")


def test_versions(spark):
    ordered = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "2.0.0", "10.0.0"]
    assert sorted(reversed(ordered), key=versions.key) == ordered
    got = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string").orderBy(versions.order_key(F.col("v"))).collect()
    assert [r.v for r in got] == ordered
    assert one(spark, versions.valid(F.lit("01.0.0"))) is False
    assert one(spark, versions.dated(F.lit("cve-2024.03.07"))) == "2024.3.7" and one(spark, versions.dated(F.lit("cve-2024.13"))) is None


def test_guard(spark):
    guard.check_graph_query("MATCH (a {t: 'DROP it'}) RETURN a")
    for bad in ("CREATE (a)", "MATCH (a) SET a.x = 1", "MATCH (a)-[*1..2]->(b) RETURN b"):
        with pytest.raises(guard.ReadOnlyError):
            guard.check_graph_query(bad)
    assert guard.run_read(spark, "SELECT * FROM range(500)", 300).count() == 200
    with pytest.raises(guard.ReadOnlyError):
        guard.run_read(spark, "DROP TABLE x", 1)


def test_delta_rejections(spark, tmp_path):
    def read(*lines):
        path = tmp_path / f"{abs(hash(lines))}.ndjson"
        path.write_text("\n".join(lines))
        return incremental.read_delta(spark, str(path))

    record = lambda key, state="PUBLISHED": json.dumps({"cveMetadata": {"cveId": key, "state": state}})
    assert read(record("CVE-2020-1000") + "\r", "", json.dumps({"operation": "upsert", "key": "CVE-2020-1001", "payload": {"a": 1}})).count() == 2
    assert read("").count() == 0
    for bad in ([json.dumps({"operation": "delete", "key": "x", "payload": {}})], [record("a"), record("a")], ["{"], [record("a", "rejected")], ["{}"]):
        with pytest.raises(incremental.DeltaError):
            read(*bad)


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, payload string")
    delta = spark.createDataFrame([("b", "3"), ("c", "4")], "key string, payload string")
    once = incremental.upsert(base, delta)
    assert sorted(map(tuple, incremental.upsert(once, delta).collect())) == sorted(map(tuple, once.collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    kinds = {r.key: r.classification for r in incremental.classify(once, delta).collect()}
    assert kinds == {"b": "unchanged", "c": "unchanged"}
    assert {r.key: r.classification for r in incremental.classify(base, delta).collect()} == {"b": "modified", "c": "added"}
    assert incremental.upsert(base, delta.limit(0)).count() == 2


def test_publish_never_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/pack"
    incremental.publish({"article": spark.range(3)}, path)
    assert spark.read.parquet(f"{path}/article.parquet").count() == 3
    with pytest.raises(FileExistsError):
        incremental.publish({"article": spark.range(4)}, path)


def test_replayed_batches_add_nothing(spark, tmp_path):
    table = f"file://{tmp_path}/table"
    for _ in range(2):
        events.append_new(spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id bigint, x string"), table, ["id"])
    assert spark.read.parquet(table).count() == 2


def test_records(spark):
    record = {
        "cveMetadata": {"cveId": "CVE-2021-12345", "state": "PUBLISHED", "datePublished": "2021-02-03T00:00:00Z"},
        "containers": {
            "cna": {"descriptions": [{"lang": "fr", "value": "non"}, {"lang": "en-US", "value": " A bug. "}], "affected": [{"vendor": "n/a", "product": "Gear"}], "problemTypes": [{"descriptions": [{"cweId": "CWE-79", "description": "CWE-79: XSS"}, {"cweId": "bad"}]}]},
            "adp": [{"problemTypes": [{"descriptions": [{"cweId": "CWE-79"}, {"cweId": "CWE-80", "description": "other"}]}], "metrics": [{"cvssV3_1": {"baseScore": 9, "baseSeverity": "critical"}}]}],
        },
    }
    other = {"cveMetadata": {"cveId": "CVE-2021-99999", "state": "REJECTED"}, "containers": {"cna": {"descriptions": [{"lang": "en", "value": "x"}]}}}
    lines = spark.createDataFrame([(json.dumps(record),), (json.dumps(other),), ("{}",), ("no json",)], "value string")
    got = records.parse_records(lines).collect()
    assert [r.article for r in got] == ["CVE-2021-12345"]
    assert got[0].content == "A bug.\n\nAffected: Gear.\n\nWeaknesses: CWE-79 XSS; CWE-80 other.\n\nSeverity: CRITICAL (CVSS 9).\n\nPublished: 2021-02-03."
    assert [(e.name, e.type) for e in got[0].entities] == [("CVE-2021-12345", "vulnerability"), ("CWE-79", "weakness"), ("CWE-80", "weakness"), ("Gear", "product")]
    assert [(x.source, x.relation, x.target) for x in got[0].relationships] == [("CVE-2021-12345", "has_weakness", "CWE-79"), ("CVE-2021-12345", "has_weakness", "CWE-80"), ("CVE-2021-12345", "affects", "Gear")]


def test_json_helpers():
    assert records.canonical_json({"b": [1, {"z": 0, "a": "é"}], "a": None}) == '{"a":null,"b":[1,{"a":"é","z":0}]}'
    with pytest.raises(ValueError, match="forbidden"):
        records.safe_json('{"a": [{"__proto__": 1}]}')


def test_verdict_fails_closed(spark):
    rows = spark.createDataFrame([('{"correct": true, "score": 3, "reasoning": "r"}',), ("x",), ('{"score": -1}',)], "t string").select(evaluate.verdict(F.col("t")).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in rows] == [(True, 1.0, "r"), (False, 0.0, ""), (False, 0.0, "")]


def test_sampling_takes_turns(spark):
    rows = spark.createDataFrame([(1, "p", "a"), (2, "p", "a"), (3, "p", "b"), (4, "p", "a"), (5, "q", "b")], "id bigint, pack string, skill string")
    got = evaluate.stratified(rows, 3).orderBy("pack_order", "position").collect()
    assert [r.id for r in got] == [1, 3, 2, 5]


def test_empty_arms(spark):
    none = spark.createDataFrame([], "id bigint, correct boolean, score double")
    assert tuple(evaluate.compare_arms(none, none).first()) == (0, 0, 0, 0.0)


def test_context_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 0, "a" * 50), (1, 1, "b" * 60), (1, 2, "c")], "k bigint, position bigint, text string")
    assert [r.position for r in catalogue.bounded_context(rows, "k", 50, 50, 90).collect()] == [0]


def test_first_of_equal_lines_is_stated(spark, tmp_path):
    """Two suppliers in one line: the query and its SQL take the same one, in whatever order the rows come."""
    from graphlore.plans import catalogue_queries  # noqa: F401
    from graphlore.plans.registry import ORACLE_SQL, QUERIES
    from tests.oracle import same

    rows = [(k, 7, 1, s) for k in range(1, 5) for s in (9 - k, 9, 3, 5)] + [(5, 8, 2, 1), (5, 7, 3, 4), (5, 7, 3, 2)]
    lines = spark.createDataFrame(rows, "l_partkey bigint, l_orderkey bigint, l_linenumber bigint, l_suppkey bigint").coalesce(1)
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    same(QUERIES["entity_first_wins"], ORACLE_SQL["entity_first_wins"], spark, str(tmp_path))


def test_records_of_one_small_file_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    from graphlore.plans import catalogue_queries

    part = spark.range(400).selectExpr("id AS p_partkey", "'name ' || id AS p_name", "'kind' AS p_type", "'b' || id % 7 AS p_brand", "cast(id % 50 + 1 AS INT) AS p_size")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(catalogue_queries, "RECORDS_A_TASK", 50)
    sizes = catalogue_queries.record_articles(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and sum(r["count"] for r in sizes) == 376
