"""File sources, guards, JSON and address odds and ends, the batch writer, deltas and gates."""

from __future__ import annotations

import json
from urllib.parse import urljoin

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from graphlore.functions import text
from graphlore.functions.columns import strip
from graphlore.operators import catalogue, evaluate, graph, incremental, vectors
from graphlore.plans import guard
from graphlore.retriever import run_eval
from graphlore.sources import files
from graphlore.sources.pack import SCHEMAS, Pack
from graphlore.streaming import writer as writer_module
from graphlore.streaming.writer import Fenced, PackWriter


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# guard ---------------------------------------------------------------------------------------------

READS = [
    "SELECT id FROM things WHERE id > 1 ORDER BY id LIMIT 3", "WITH a AS (SELECT max(id) AS m FROM things) SELECT t.id FROM things t JOIN a ON t.id < a.m",
    "SELECT id FROM things WHERE id IN (SELECT id FROM things) AND EXISTS (SELECT 1 FROM things b WHERE b.id = things.id)", "SELECT count(DISTINCT upper(name)), sum(id) OVER (PARTITION BY name) FROM things GROUP BY id, name",
    "SELECT x FROM things LATERAL VIEW explode(array(id, id + 1)) e AS x", "SELECT sum(id) OVER w AS s FROM things WINDOW w AS (PARTITION BY name ORDER BY id)", "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM b",
    "SELECT name, CASE WHEN id > 1 THEN 'x' ELSE -id END, name COLLATE UNICODE_CI = 'A', transform(array(id), v -> v + 1)[0] FROM things", "SELECT name, count(*) FILTER (WHERE id > 1) FROM things GROUP BY ROLLUP (name) HAVING count(*) > 0 ORDER BY ALL",
    "FROM things |> SELECT id", "SELECT * EXCEPT (name) FROM things WHERE name LIKE ANY ('a%', '%b') AND id BETWEEN 1 AND 2", "SELECT id FROM things UNION ALL SELECT * FROM range(3)", "VALUES (1), (2)",
]
REFUSED = [
    "DROP TABLE things", "INSERT INTO things SELECT 1, 'a'", "CREATE TABLE x AS SELECT 1", "SET spark.sql.ansi.enabled = false", "SHOW TABLES",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT id FROM things WHERE name = java_method('java.lang.System', 'getenv', 'HOME')", "SELECT try_reflect('java.lang.Runtime', 'getRuntime')",
    "SELECT * FROM parquet.`/etc`", "SELECT * FROM text.`/etc/passwd`", "SELECT * FROM things WHERE id IN (SELECT value FROM text.`/etc/passwd`)", "WITH a AS (SELECT * FROM json.`/etc`) SELECT * FROM a",
    "SELECT (SELECT reflect('java.lang.System', 'getProperty', 'user.home')) AS x", "SELECT id FROM unknown_table", "SELECT TRANSFORM(id) USING 'cat' AS x FROM things", "SELECT input_file_name() FROM things",
    "SELECT x FROM things LATERAL VIEW explode(array(reflect('java.lang.System', 'getProperty', 'user.home'))) e AS x", "SELECT * FROM read_files('/etc')", "EXPLAIN SELECT 1", "CALL something()",
    # a function or table whose name is computed, the pipe syntax, windows that have names, and names that are seen elsewhere only
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') AS x FROM things", "FROM things |> SELECT IDENTIFIER('java_method')('java.lang.System', 'getenv', 'HOME')", "SELECT * FROM IDENTIFIER('things')",
    "SELECT sum(id) OVER w FROM things WINDOW w AS (ORDER BY reflect('java.lang.System', 'getProperty', 'user.home'))", "SELECT builtin.reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT * FROM hidden WHERE EXISTS (WITH hidden AS (SELECT 1) SELECT * FROM hidden)", "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden", "WITH a AS (SELECT * FROM hidden), hidden AS (SELECT 1) SELECT * FROM a",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT * FROM r", "SELECT raise_error('x')", "SELECT session_user()", "SELECT explode(array(reflect('java.lang.System', 'getenv', 'HOME')))",
]


@pytest.fixture(scope="module")
def things(spark):
    spark.createDataFrame([(k, f"n{k % 3}") for k in range(10)], "id bigint, name string").createOrReplaceTempView("things")


@pytest.mark.parametrize("sql", READS)
def test_reads_pass(spark, things, sql):
    guard.check_read(spark, sql)


@pytest.mark.parametrize("sql", REFUSED)
def test_everything_else_is_refused(spark, things, sql):
    with pytest.raises(guard.ReadOnlyError):
        guard.check_read(spark, sql)


def test_run_read(spark, things):
    assert guard.run_read(spark, READS[0], 2).count() == 2
    with pytest.raises(guard.ReadOnlyError):
        guard.run_read(spark, "SELECT id FROM things", 5, tables={"others"})
    spark.range(3).createOrReplaceTempView("hidden")
    for sql in ("SELECT * FROM hidden WHERE EXISTS (WITH hidden AS (SELECT 1) SELECT * FROM hidden)", "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden"):
        with pytest.raises(guard.ReadOnlyError, match="hidden"):
            guard.run_read(spark, sql, 5, tables={"things"})
    spark.catalog.dropTempView("hidden")
    assert guard.run_read(spark, "WITH hidden AS (SELECT id FROM things) SELECT * FROM hidden", 1, tables={"things"}).count() == 1


def test_statements_in_sequence_give_the_rows_of_the_last(spark, things):
    last = "SELECT count(*) AS n, ';' AS c FROM things WHERE id < :k"
    for sql in (last, f"{last};", f"SELECT 1 AS x; {last}", f"SELECT id FROM things; -- done; soon\n{last} ;\n", f"/* ; */ SELECT 1;\n{last} -- end"):
        assert [tuple(r) for r in guard.run_reads(spark, sql, 5, tables={"things"}, args={"k": 4}).collect()] == [(4, ";")]
    assert guard.run_reads(spark, "SELECT 1; SELECT id FROM things", 3).count() == 3


@pytest.mark.parametrize("sql", [
    "DROP TABLE things; SELECT 1", "SELECT 1; INSERT INTO things SELECT 1, 'a'", "SELECT reflect('java.lang.System', 'getenv', 'HOME'); SELECT 1", "SELECT id FROM hidden; SELECT 1", "DECLARE x INT DEFAULT 1; SELECT x",
    "IF 1 = 1 THEN DROP TABLE things; END IF", "WHILE true DO SELECT 1; END WHILE", "BEGIN DROP TABLE things; END", "DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN DROP TABLE things; END; SELECT 1 / 0", "EXECUTE IMMEDIATE 'DROP TABLE things'; SELECT 1",
])
def test_statements_that_do_more_than_read_are_refused(spark, things, sql):
    with pytest.raises(guard.ReadOnlyError):
        guard.run_reads(spark, sql, 5, tables={"things"})


@pytest.mark.parametrize("sql", ["", ";", "SELECT 1; END; DROP TABLE things; BEGIN SELECT 1", "SET VAR x = 1; SELECT 1"])
def test_what_is_no_script_is_refused(spark, things, sql):
    with pytest.raises((guard.ReadOnlyError, ParseException)):
        guard.run_reads(spark, sql, 5, tables={"things"})


# text ----------------------------------------------------------------------------------------------

def test_windows_of_a_very_long_text(spark):
    """The work grows with the text, and windows go on across the pieces that it is dealt into."""
    long = "é x" * 300_000
    want = [long[k : k + 512] for k in range(0, len(long) - 64, 448)]
    df = spark.createDataFrame([(f" {long}\n",)], "t string").select(text.windows(F.col("t")).alias("w"), text.windows(F.col("t"), 100, 10).alias("v"))
    got = df.first()
    assert got.w == want and len(got.v) == -(-(len(long) - 100) // 90) + 1 and got.v[-1] == long[90 * (len(got.v) - 1) :]


def test_mentions_and_links(spark):
    many = "CVE-1x " * 20_000 + "CVE-1"
    assert one(spark, text.cites(F.lit(many), F.lit("CVE-1"))) == len(many) - 4
    assert [one(spark, text.cites(F.lit(x), F.lit("a+"))) for x in ("", "a", "a+", "b a+1 a+.", "a+_")] == [0, 0, 1, 7, 0]
    page = "<a href=\"\n/x\t\">1</a><a href='\u00a0b.html\u3000'>2</a><a href=' #top '>3</a>"
    assert one(spark, text.links(F.lit(page), F.lit("https://h.org/d/p.html"))) == ["https://h.org/x", "https://h.org/d/b.html"]


@pytest.mark.parametrize("value", ["\n\tabc d\n", "\u00a0\ufeffabc d\u3000", "\x0b\x0cabc d\r", "abc d"])
def test_trimming(spark, value):
    assert one(spark, strip(F.lit(value))) == "abc d"
    assert one(spark, text.windows(F.lit(value), 3, 1)) == ["abc", "c d"]
    assert one(spark, text.relation(F.lit(value.replace("abc d", "Found")))) == "discovered"


def test_addresses_of_both_families(spark):
    import ipaddress
    import random

    rng = random.Random(5)
    known = ["::", "::1", "::2", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::8.8.8.8", "::ffff:0808:0808", "fe80::1", "febf::", "fec0::1", "feff::", "fd00::1", "fbff::1", "ff02::1", "2001:db8::1", "2001:0DB8:0::", "2001:db9::1", "2606:4700::1111",
             "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "g::1", "12345::", "::1.2.3", "::1.2.3.256", "64:ff9b::1.2.3.4", "", ":", "no", "10.0.0.1", "8.8.8.8", "256.1.1.1"]
    made = [str(ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 0, 64, 96, 112]))) for _ in range(200)]
    made += [ipaddress.IPv6Address((rng.choice([0xFE80, 0xFD12, 0x2001, 0xFF05, 0x2A00]) << 112) + rng.getrandbits(100)).exploded.upper() for _ in range(100)]
    rows = spark.createDataFrame([(x,) for x in [*known, *made]], "ip string")
    got = {r.ip: r.b for r in rows.select("ip", text.ip_blocked_column(F.col("ip")).alias("b")).collect()}
    assert {x: b for x, b in got.items() if b != text.ip_blocked(x)} == {}
    assert spark.range(1).select(text.ip_blocked_column(F.lit(None).cast("string")).alias("b")).first().b is True


HREFS = ["a", "./a", "../a", "../../a/./b/", "/x/../y", "a/..", "..", ".", "?q=1", "//host.org/z/../w", "https://host.org/a/b/../../c?d=../e", "../../../../top", "a/./../b?x#frag", "/a/b/.", "/..a/b.."]


def test_links_are_resolved(spark):
    base = "https://host.org/one/two/page.html"
    html = " ".join(f'<a href="{h}">x</a>' for h in HREFS)
    # joined twice, as an address with a host is left as it is the first time
    host = "https://host.org"
    want = list(dict.fromkeys(urljoin(host, urljoin(base, h).removeprefix(host)).partition("#")[0] for h in HREFS))
    assert one(spark, text.links(F.lit(html), F.lit(base))) == want
    assert one(spark, text.links(F.lit('<a href="x//y/../z">'), F.lit(base))) == ["https://host.org/one/two/x//z"]


def test_string_lists_and_templates(spark):
    ok = lambda x: one(spark, text.string_list(F.lit(x)))
    assert ok('["a"]') == ["a"] and ok("[]") == [] and ok('[1]') is None and ok('["a", null]') is None and ok("x") is None and ok(None) is None
    assert one(spark, text.fill("{{a}}-{{b}}-{{c}}", {"a": F.lit("{{b}}"), "b": F.lit(None)})) == "{{b}}--{{c}}"


def test_surrogates_and_canonical_json(spark):
    for raw, bad in [(r"\ud83d\ude00", False), (r"\ud83d", True), (r"\\ud83d", False), (r"\\\ud83d", True), (r"\ude00\ud83d", True)]:
        assert one(spark, text.lone_surrogate(F.lit(raw))) == bad, raw
    value = {"b": [{"z": 1, "a": None}, 2.5], "a": {"y": True, "x": "s"}}
    assert one(spark, text.canonical_json(F.lit(json.dumps(value)))) == json.dumps(value, sort_keys=True, separators=(",", ":"))
    assert one(spark, text.safe_json(F.lit('{"a": {"__proto__": 1}}'))) is None
    assert one(spark, text.safe_json(F.lit('{"a": "x,\\"constructor\\":"}'))) is not None
    assert one(spark, text.safe_json(F.lit("no"))) is None


def test_dates(spark):
    day = lambda x: one(spark, text.real_date(F.lit(x)))
    assert str(day("2024-02-29")) == "2024-02-29" and day("2023-02-29") is None and day("2024-2-9") is None and day("2024-13-01") is None
    assert str(one(spark, text.tag_date(F.lit("pack-2024-02-29_1")))) == "2024-02-29" and one(spark, text.tag_date(F.lit("pack-12024-02-290"))) is None


# files ---------------------------------------------------------------------------------------------

def test_file_tree(spark, tmp_path):
    for year, n in ((2023, 2), (2024, 3)):
        (tmp_path / "tree" / str(year) / "a b").mkdir(parents=True)
        for k in range(n):
            (tmp_path / "tree" / str(year) / "a b" / f"CVE-{year}-{k:04d}.json").write_text(json.dumps({"k": k, "year": year}, indent=1))
    (tmp_path / "tree" / "other.json").write_text("{}")
    got = files.json_tree(spark, str(tmp_path / "tree")).collect()
    assert [r.name for r in got] == sorted(r.name for r in got) and len(got) == 5 and json.loads(got[-1].payload) == {"k": 2, "year": 2024}
    assert [r.name for r in files.json_tree(spark, str(tmp_path / "tree"), year=2024, limit=2).collect()] == ["CVE-2024-0000.json", "CVE-2024-0001.json"]


def test_url_list_and_questions(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# seeds\nhttps://b.org/\n\n  https://a.org/x  \nhttps://b.org/\n")
    assert [r.url for r in files.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://b.org/", "https://a.org/x"]
    (tmp_path / "eval.jsonl").write_text('{"id": "1", "question": "q?", "answer": "a", "more": 2}\n\n{"id": 2, "question": "r?", "skill": "s"}\n')
    assert {(r.id, r.question, r.answer, r.skill) for r in files.questions(spark, path=str(tmp_path / "eval.jsonl")).collect()} == {("1", "q?", "a", None), ("2", "r?", None, "s")}
    assert files.questions(spark, rows=[("1", "q", "a", "s")]).count() == 1
    for bad in ({}, {"rows": [], "path": "x"}, {"rows": [("1", " ", "a", "s")]}, {"rows": [("1", "q", "a", "s"), ("1", "r", "a", "s")]}):
        with pytest.raises(ValueError, match="exactly one|rejected"):
            files.questions(spark, **bad)


def test_introspection_reads_the_tables(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema + ", extra int" if name == "article" else schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = Pack.open(spark, str(tmp_path)).introspect().collect()
    assert ("article", "extra", "int", 4) in {tuple(r) for r in rows} and {r.table_name for r in rows} == set(SCHEMAS)


# writer, deltas, gates -----------------------------------------------------------------------------

BATCH = "title string, position bigint, content string, entities array<struct<entity_id:string,name:string>>, links array<string>, relations array<struct<source:string,target:string,relation:string>>"


def _batches():
    return [
        [("a", 0, "A", [("e1", "one"), ("e2", "two"), (None, "x")], ["b", "zz", "a"], [("e1", "e3", "uses"), ("e1", "e9", "uses")]), ("a", 1, "again", [("e7", "never")], [], [])],
        [("b", 2, "B", [("e3", "three"), ("e1", "other name")], ["a"], [("e1", "e3", "uses")]), ("a", 3, "late", [("e8", "never")], ["b"], [])],
        [("c", 4, "C", [], ["a", "b"], []), (None, 5, "no title", [], [], [])],
    ]


def _tables(spark, folder):
    read = lambda t, *c: {tuple(r) for r in spark.read.parquet(f"{folder}/{t}").select(*c).collect()}
    return read("article", "title", "content"), read("entity", "entity_id", "name", "first_article"), read("has_entity", "article", "entity_id"), read("links", "source", "target"), read("entity_relation", "source", "target", "relation")


def test_only_repeated_titles_are_settled_with_their_rows(spark, tmp_path, monkeypatch):
    """In one batch or over several, the earliest batch's first position stays; rows whose title is there once are not grouped."""
    seen, settle = [], writer_module.first_wins
    monkeypatch.setattr(writer_module, "first_wins", lambda rows, keys, order: seen.append((keys, rows.count())) or settle(rows, keys, order))
    batch = lambda *rows: spark.createDataFrame([(t, p, c, [("e", c), ("e", c)], ["a", "a"], [("e", "e", "r")] * 2) for t, p, c in rows], BATCH)
    writer = PackWriter(spark, str(tmp_path))
    writer.write(batch(("a", 2, "late"), ("a", 1, "first"), ("b", 3, "b")), 0)
    writer.write(batch(("a", 0, "other"), ("c", 4, "c")), 1)
    got = writer.snapshot()
    assert [n for keys, n in seen if keys == ["title"]] == [3]
    assert sorted((r.title, r.content) for r in got["article"].collect()) == [("a", "first"), ("b", "b"), ("c", "c")]
    assert sorted(tuple(r) for r in got["has_entity"].collect()) == [("a", "e"), ("b", "e"), ("c", "e")]
    assert sorted(tuple(r) for r in got["links"].collect()) == [("b", "a"), ("c", "a")] and got["entity_relation"].count() == 1


def test_batch_writer_resumes_and_replays(spark, tmp_path):
    want = (
        {("a", "A"), ("b", "B"), ("c", "C")}, {("e1", "one", "a"), ("e2", "two", "a"), ("e3", "three", "b")}, {("a", "e1"), ("a", "e2"), ("b", "e3"), ("b", "e1")},
        {("a", "b"), ("b", "a"), ("c", "a"), ("c", "b")}, {("e1", "e3", "uses")},
    )
    frames = [spark.createDataFrame(b, BATCH) for b in _batches()]
    once, torn = str(tmp_path / "once"), str(tmp_path / "torn")
    for k, df in enumerate(frames):
        PackWriter(spark, once).write(df, k)
    assert _tables(spark, PackWriter(spark, once).finish()) == want and PackWriter(spark, once).batches() == 3
    PackWriter(spark, torn).write(frames[0], 0)
    before = PackWriter(spark, torn).snapshot()
    # the second batch stops before its commit: nobody reads it, and a pack of now doesn't have it
    frames[1].write.parquet(f"{torn}/batches/{1:012d}-torn")
    resumed = PackWriter(spark, torn)
    assert resumed.batches() == 1 and {r.title for r in resumed.stored("article").collect()} == {r.title for r in frames[0].collect() if r.title}
    assert {r.title for r in spark.read.parquet(resumed.finish() + "/article").collect()} == {r.title for r in before["article"].collect()}
    for k in (1, 2, 2, 0):
        resumed.write(frames[k], k)
    assert _tables(spark, resumed.finish()) == want
    assert {r.title for r in before["article"].collect()} == {r.title for r in PackWriter(spark, torn).snapshot(1)["article"].collect()}  # a snapshot stays what it was


def test_a_write_that_fails_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    frames = [spark.createDataFrame(b, BATCH) for b in _batches()]
    writer = PackWriter(spark, str(tmp_path))
    assert writer.stored("article") is None and writer.snapshot()["links"].count() == 0
    writer.write(frames[0], 0)
    kept = {name: df.count() for name, df in writer.snapshot().items()}

    def stop(path, text, over=False):
        raise OSError("lost before the commit")

    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(writer, "_create", stop)
        writer.write(frames[1], 1)
    assert {name: df.count() for name, df in writer.snapshot().items()} == kept and writer.batches() == 1
    (tmp_path / "commits" / f"{1:012d}").write_bytes(b"")  # a commit whose writer was lost before it was closed
    assert writer.batches() == 1
    writer.write(frames[1], 1)
    assert writer.batches() == 2


def test_a_second_writer_fences_the_first_off(spark, tmp_path):
    frames = [spark.createDataFrame(b, BATCH) for b in _batches()]
    first, second = PackWriter(spark, str(tmp_path)), PackWriter(spark, str(tmp_path))
    first.write(frames[0], 0)
    second.write(frames[1], 1)
    with pytest.raises(Fenced):
        first.write(frames[2], 2)
    second.write(frames[2], 2)
    assert second.batches() == 3 and {r.title for r in second.stored("article").collect()} == {"a", "b", "c"}


def test_a_batch_reads_no_other(spark, tmp_path):
    """What a batch costs doesn't grow with those before it."""
    frames = [spark.createDataFrame(b, BATCH) for b in _batches()]
    writer = PackWriter(spark, str(tmp_path))
    writer.write(frames[0], 0)
    for file in (tmp_path / writer.commits()[0]).glob("*.parquet"):
        file.write_bytes(b"unreadable")
    writer.write(frames[1], 1)
    assert writer.batches() == 2


def test_stream_into_a_pack(spark, tmp_path):
    for k, b in enumerate(_batches()):
        spark.createDataFrame(b, BATCH).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    writer = PackWriter(spark, str(tmp_path / "pack"))
    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer.stream(stream, str(tmp_path / "at")).awaitTermination()
    assert writer.batches() >= 3 and {r.title for r in spark.read.parquet(writer.finish() + "/article").collect()} == {"a", "b", "c"}


def test_only_changed_rows_are_embedded(spark):
    base = spark.createDataFrame([("a", "1", [1.0]), ("b", "2", [2.0]), ("c", "3", [3.0])], "key string, payload string, embedding array<float>")
    delta = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "y")], "key string, payload string")
    seen = []

    def embed(rows):
        seen.append(sorted(r.key for r in rows.collect()))
        return rows.withColumn("embedding", F.array(F.lit(9.0)))

    got = {r.key: (r.payload, r.embedding, r.reused) for r in incremental.recompute(base, delta, embed).collect()}
    assert seen == [["c", "d"]] and got == {"a": ("1", [1.0], True), "b": ("2", [2.0], True), "c": ("x", [9.0], False), "d": ("y", [9.0], False)}
    assert {r.key for r in incremental.recompute(base, delta.limit(0), embed).collect()} == {"a", "b", "c"}


def test_build_identity_follows_everything(spark):
    delta = spark.createDataFrame([("d",)], "delta_id string")
    build = lambda *a: incremental.build_identity(delta, *a).first().build_id
    base = ("p", "1", "b", "m", {"x": "1", "y": "2"})
    others = [("q", "1", "b", "m", {"x": "1", "y": "2"}), ("p", "2", "b", "m", {"x": "1", "y": "2"}), ("p", "1", "c", "m", {"x": "1", "y": "2"}), ("p", "1", "b", "n", {"x": "1", "y": "2"}), ("p", "1", "b", "m", {"x": "1"})]
    assert build(*base) == build(*base[:4], {"y": "2", "x": "1"}) and len({build(*x) for x in [base, *others]}) == 6


def test_probe_and_gate(spark):
    live = spark.createDataFrame([(k,) for k in range(4)], "id bigint")
    hits = spark.createDataFrame([(q, k) for q in (1, 2) for k in (0, 1)], "query bigint, id bigint")
    assert tuple(incremental.probe(hits, live, 2).first()) == (4, 4, 4, True)
    assert tuple(incremental.probe(hits.unionByName(hits.limit(1)), live.filter("id > 0"), 2).first())[3] is False
    arms = spark.createDataFrame([("full", 0.9), ("small", 0.885)], "arm string, accuracy double")
    score = lambda *x: spark.createDataFrame([(v,) for v in x], "hit double")
    assert evaluate.adoption_gate(score(1.0, 0.97), arms).first().adopt is True and evaluate.adoption_gate(score(1.0, 0.9), arms).first().adopt is False
    assert evaluate.adoption_gate(score(1.0), arms.filter("arm = 'full'")).first().adopt is False


def test_details_in_order(spark):
    article = spark.createDataFrame([("t", "c", 3)], "title string, category string, word_count bigint")
    section = spark.createDataFrame([("t", k, f"h{k}", 1, "x") for k in (10, 2, 0)], "article string, section_index bigint, title string, level bigint, content string")
    pairs = spark.createDataFrame([("t", f"n{k:03d}") for k in range(600)] + [("z", "t"), ("b", "t")], "source string, target string")
    r = catalogue.full_details(article, section, pairs, "t").first()
    assert [s.section_index for s in r.sections] == [0, 2, 10] and len(r.links) == 500 and r.links == sorted(r.links) and r.backlinks == ["b", "z"] and r.url.endswith("/t")


def test_crawl_is_cut_before_it_is_numbered(spark):
    pages = spark.range(100).withColumnRenamed("id", "page")
    links = pages.select("page", F.posexplode(F.array((F.col("page") * 3) % 100, (F.col("page") * 5 + 1) % 100)).alias("index", "target"))
    seeds = spark.createDataFrame([(1, 0), (2, 1)], "page bigint, index bigint")
    assert [r.page for r in graph.discover(pages, links, seeds, 1, 5).orderBy("position").collect()] == [3, 6, 11]


def test_codes_of_the_wrong_length_are_an_error(spark):
    v = spark.createDataFrame([([0.5, -1.0, 0.25],)], "v array<float>").withColumn("q", vectors.quantize(F.col("v")))
    assert v.select(vectors.dequantize(F.col("q"), 3).alias("x")).first().x == pytest.approx([0.5, -1.0, 0.25], abs=0.01)
    with pytest.raises(Exception, match="finite scale"):
        v.select(vectors.dequantize(F.col("q"), 4)).collect()
    with pytest.raises(Exception, match="finite scale"):
        v.select(vectors.dequantize(F.struct(F.lit(float("nan")).alias("scale"), F.col("q.codes").alias("codes")), 3)).collect()


def test_page_sections(spark):
    html = "<title>t</title><p>lead <b>x</b></p><h1>One</h1><p>a</p><p> b </p><h2></h2><p>lost</p><h3>Empty</h3><h2>Two &amp; more</h2>c"
    rows = text.sections(spark.createDataFrame([(1, html), (2, ""), (3, "<h1>A</h1>x")], "p int, html string"), "p").collect()
    got = {k: [(r.section_index, r.level, r.title, r.content) for r in rows if r.p == k] for k in (1, 2, 3)}
    assert got[1] == [(0, 0, "", "lead x"), (1, 1, "One", "a\nb"), (2, 2, "Two & more", "c")]
    assert got[2] == [(0, 0, "", "")] and got[3] == [(0, 0, "", ""), (1, 1, "A", "x")]


def test_a_failing_article_stops_no_other(spark):
    def run(x):
        if x == "bad":
            raise KeyError("no model")
        return x.upper()

    rows = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "y")], "title string, content string")
    done, skipped = incremental.isolate(rows, "title", "content", run)
    assert {(r.title, r.value) for r in done.collect()} == {("a", "X"), ("c", "Y")} and [tuple(r) for r in skipped.collect()] == [("b", "KeyError: 'no model'")]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "source string, target string")
    assert [tuple(r) for r in incremental.without(links, skipped, "title").collect()] == [("a", "c")]


def test_views_and_parameters(spark, small):
    names = Pack.derive(spark, small).register("pk_")
    assert "pk_article" in names
    got = guard.run_read(spark, "SELECT title FROM pk_article WHERE category = :c ORDER BY title", 3, tables=set(names), args={"c": "en"}).collect()
    assert len(got) == 3 and all(r.title.startswith("doc-") for r in got)


def test_judges_by_skill(spark):
    questions = spark.createDataFrame([("1", "q", "a", "lookup"), ("2", "r", "b", "other")], "id string, question string, answer string, skill string")
    say = lambda ok: json.dumps({"correct": ok, "score": 1.0, "reasoning": ""})
    rows = run_eval(questions, {"pack": lambda q: "a"}, lambda r, said: say(False), {"lookup": lambda r, said: say(r["answer"] == said)}).collect()
    assert {(r.arm, r.id, r.correct) for r in rows} == {("pack", "1", True), ("pack", "2", False)}
