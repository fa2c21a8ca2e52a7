"""The extraction seam and statistics over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlore.operators import catalogue
from graphlore.operators.extraction import extracted


class Words:
    """Every capitalised word an entity; fails on purpose, and where it was left open."""

    def __init__(self):
        self.open = True

    def extract(self, article):
        if "boom" in article["text"]:
            raise RuntimeError("boom")
        names = [w for w in article["text"].split() if w[:1].isupper()]
        return {"entities": [{"name": n, "type": "word"} for n in names], "relationships": [{"source": names[0], "target": n, "relation": "near", "context": 3} for n in names[1:]], "key_facts": [article["text"]]}

    def close(self):
        assert self.open
        self.open = False


def test_sections_of_an_article_meet_in_order(spark):
    rows = [("a", 2, "Third"), ("a", 0, "First x"), ("a", 1, None), ("b", 0, "boom"), ("c", 0, "none here"), (None, 0, "Null"), ("d", 0, "")]
    sections = spark.createDataFrame(rows, "article string, section_index int, content string").withColumn("kind", F.lit("clash")).repartition(4)
    got = sorted((r.article or "", r.kind, r.name or r.source or r.detail or "", r.target or "", r.relation or "") for r in extracted(sections, Words).collect())
    assert got == [
        ("", "entity", "Null", "", "word"), ("", "fact", "Null", "", ""),
        ("a", "entity", "First", "", "word"), ("a", "entity", "Third", "", "word"), ("a", "fact", "First x\n\n\n\nThird", "", ""), ("a", "relation", "First", "Third", "near"),
        ("b", "error", "RuntimeError: boom", "", ""), ("c", "fact", "none here", "", ""), ("d", "fact", "", "", ""),
    ]
    assert extracted(sections.filter("article = 'zz'"), Words).count() == 0


def test_an_extractor_without_answers_or_with_bad_ones(spark):
    class Odd:
        def extract(self, article):
            return {} if article["title"] == "a" else {"entities": [3]}

    sections = spark.createDataFrame([("a", 0, "x"), ("b", 0, "x")], "article string, section_index int, content string")
    got = extracted(sections, Odd).collect()
    assert [(r.article, r.kind) for r in got] == [("b", "error")]


def test_cube_tells_totals_from_nulls(spark):
    articles = spark.createDataFrame([("x", 0, 5), ("x", 1, 7), (None, 0, 1)], "category string, expansion_depth long, word_count long")
    got = {(r.category, r.expansion_depth, r.level): (r.articles, r.words) for r in catalogue.stats_cube(articles).collect()}
    assert got == {("x", 0, 0): (1, 5), ("x", 1, 0): (1, 7), (None, 0, 0): (1, 1), ("x", None, 1): (2, 12), (None, None, 1): (1, 1), (None, 0, 2): (2, 6), (None, 1, 2): (1, 7), (None, None, 3): (3, 13)}


def test_sketches_merge_within_their_bounds(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("kind"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 10 as int))").alias("at"), F.when(F.col("id") % 5 == 0, F.lit(1)).otherwise(F.col("id")).alias("who"))
    days = catalogue.daily_sketches(rows, "kind", "at", "who")
    assert days.count() == 10
    got = {r.kind: r for r in catalogue.merged_sketches(days, "kind", 1).collect()}
    exact = {r.kind: r.n for r in rows.groupBy("kind").agg(F.countDistinct("who").alias("n")).collect()}
    for kind, r in got.items():
        assert abs(r.n_distinct - exact[kind]) <= 0.03 * exact[kind]
        assert r.top[0].item == 1 and abs(r.top[0]["count"] - 6000) <= 600


def test_collated_groups(spark):
    words = spark.createDataFrame([(w,) for w in ("eté", "Été", "ete", "zoo", "Zoo", "été", None)], "w string")
    got = [(r["first"], r.n, r.spellings) for r in catalogue.alike(words, "w").collect()]
    assert got == [(None, 1, 0), ("ete", 4, 4), ("Zoo", 2, 2)]
    assert [r.n for r in catalogue.alike(words.filter("w like '%t%'"), "w", "UNICODE_CI").collect()] == [1, 1, 2]


def test_counts_of_more_users_than_a_sketch_holds(spark, tmp_path):
    """5,000 users, all rare but three: the counts are exact, though sketches of days forget users."""
    from graphlore.plans import corpus_queries  # noqa: F401
    from graphlore.plans.registry import ORACLE_SQL, QUERIES
    from tests.oracle import same

    times = "array_repeat(id, CASE id WHEN 9 THEN 6 WHEN 4000 THEN 5 WHEN 77 THEN 4 ELSE 1 + cast(id % 3 = 0 AS INT) END)"
    e = spark.range(5000).selectExpr("'view' AS event_type", f"posexplode({times}) AS (n, user_id)").selectExpr("event_type", "user_id", "timestamp'2024-01-01' + make_dt_interval(cast((n + user_id) % 5 AS INT)) AS ts")
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    same(QUERIES["sketched_users"], ORACLE_SQL["sketched_users"], spark, str(tmp_path))
