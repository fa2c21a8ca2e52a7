"""Catalogue reads: categories, statistics, details, summaries, completion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlore.functions.text import wiki_url

MOST_LINKS = 500
SUMMARY = 200


def round1(x: Column) -> Column:
    """One decimal, halves up."""
    return F.floor(x * 10 + 0.5) / 10


def category_counts(articles: DataFrame) -> DataFrame:
    return articles.filter("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("articles")).orderBy(F.desc("articles"), "category")


def depth_histogram(articles: DataFrame) -> DataFrame:
    return articles.filter("expansion_depth is not null").groupBy("expansion_depth").agg(F.count(F.lit(1)).alias("articles"))


def corpus_stats(tables: dict[str, DataFrame], per_article: list[str]) -> DataFrame:
    """metric, value: the count of each table, and how many rows of some there are for an article."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
        counts = one if counts is None else counts.unionByName(one)
    n = counts.filter(F.col("metric") == "articles").select(F.col("value").alias("n"))
    rates = counts.filter(F.col("metric").isin(per_article)).join(F.broadcast(n))
    rates = rates.select(F.concat(F.lit("avg_"), "metric", F.lit("_per_article")).alias("metric"), F.when(F.col("n") > 0, round1(F.col("value") / F.col("n"))).otherwise(0.0).alias("value"))
    return counts.unionByName(rates)


def summaries(sections: DataFrame) -> DataFrame:
    """article, summary: the lead's first 200 characters; articles without content are left out."""
    short = F.when(F.length("content") > SUMMARY, F.concat(F.substring("content", 1, SUMMARY), F.lit("..."))).otherwise(F.col("content"))
    return sections.filter("section_index = 0 and content <> ''").select("article", short.alias("summary"))


def autocomplete(titles: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """title, tier: titles that begin with a text, then those that hold it."""
    if len(text) < 2:
        raise ValueError("at least two characters")
    low = F.lower("title")
    tier = F.when(F.startswith(low, F.lit(text.lower())), 0).when(F.contains(low, F.lit(text.lower())), 1)
    return titles.select("title", tier.alias("tier")).filter("tier is not null").orderBy("tier", "title").limit(limit)


def details(articles: DataFrame, sections: DataFrame, pairs: DataFrame, title: str) -> DataFrame:
    """One row of an article: its sections and its sorted links and backlinks, 500 of each at most."""
    own = articles.filter(F.col("title") == title).select("title", "category", "word_count")
    parts = sections.filter(F.col("article") == title).groupBy("article").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("content")).alias("n_chars"))
    listed = lambda df, c: df.select(c).distinct().orderBy(c).limit(MOST_LINKS).agg(F.array_join(F.array_sort(F.collect_list(c)), "|").alias(c))
    out = listed(pairs.filter(F.col("source") == title), "target").withColumnRenamed("target", "links")
    back = listed(pairs.filter(F.col("target") == title), "source").withColumnRenamed("source", "backlinks")
    joined = own.join(parts, own["title"] == parts["article"], "left").drop("article")
    return joined.join(F.broadcast(out)).join(F.broadcast(back))


def full_details(articles: DataFrame, sections: DataFrame, pairs: DataFrame, title: str) -> DataFrame:
    """One row of an article: category, words, address, its sections in order and its sorted links and backlinks, 500 of each at most."""
    own = articles.filter(F.col("title") == title).select("title", "category", "word_count", wiki_url(F.col("title")).alias("url"))
    part = F.struct("section_index", F.col("title").alias("heading"), "level", "content")
    parts = sections.filter(F.col("article") == title).groupBy(F.col("article").alias("title")).agg(F.array_sort(F.collect_list(part)).alias("sections"))
    listed = lambda df, c, name: df.select(c).distinct().orderBy(c).limit(MOST_LINKS).agg(F.array_sort(F.collect_list(c)).alias(name))
    out, back = listed(pairs.filter(F.col("source") == title), "target", "links"), listed(pairs.filter(F.col("target") == title), "source", "backlinks")
    return own.join(parts, "title", "left").join(F.broadcast(out)).join(F.broadcast(back))


def full_stats(tables: dict[str, DataFrame], per_article: list[str], articles: DataFrame) -> DataFrame:
    """kind, name, value: counts and rates of :func:`corpus_stats`, articles by category and by depth. A few rows; a service may keep them for a while."""
    counts = corpus_stats(tables, per_article).select(F.when(F.startswith("metric", F.lit("avg_")), "rate").otherwise("count").alias("kind"), F.col("metric").alias("name"), "value")
    by = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name"), F.col("articles").cast("double").alias("value"))
    return counts.unionByName(by("category", category_counts(articles), "category")).unionByName(by("depth", depth_histogram(articles), "expansion_depth"))


def sourced(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with what they were made from, by title."""
    return articles.join(sources, "title")


def chat_sources(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """article, position: articles of retrieved sections, each once, as retrieved."""
    found = hits.join(sections.select("id", "article"), "id").groupBy("article").agg(F.min("rank").alias("first"))
    return found.select("article", F.row_number().over(Window.orderBy("first")).cast("bigint").alias("position"))


def bounded_context(rows: DataFrame, by: str, most_rows: int = 50, chars: int = 8_000, total: int = 60_000) -> DataFrame:
    """rows of by, position, text that fit a prompt: cut to ``chars`` each, stopping at the first that passes the total."""
    w = Window.partitionBy(by).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.withColumn("used", F.least(F.length("text"), F.lit(chars)).cast("bigint"))
    run = cut.withColumns({"n": F.count(F.lit(1)).over(w), "chars": F.sum("used").over(w)})
    return run.filter((F.col("n") <= most_rows) & (F.col("chars") <= total)).select(by, "position", "used", "chars")


def stats_cube(articles: DataFrame) -> DataFrame:
    """category, expansion_depth, level, articles, words: counts by both, by either and of all, in one pass.

    ``level`` tells a total from a null: 0 both are given, 1 the depth is any, 2 the category is any, 3 both are.
    """
    cube = articles.cube("category", "expansion_depth").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("articles"), F.sum("word_count").alias("words"))
    return cube.select("category", "expansion_depth", "level", "articles", "words")


def daily_sketches(rows: DataFrame, by: str, at: str, what: str, capacity: int = 1024) -> DataFrame:
    """by, day, distinct_sketch, top_sketch: what days keep of ``what`` so that any days can be merged, a few kilobytes each."""
    return rows.groupBy(by, F.to_date(at).alias("day")).agg(F.hll_sketch_agg(what, F.lit(14)).alias("distinct_sketch"), F.expr(f"approx_top_k_accumulate({what}, {capacity})").alias("top_sketch"))


def merged_sketches(sketches: DataFrame, by: str, k: int, capacity: int = 1024) -> DataFrame:
    """by, n_distinct (standard error 0.8 %), top: the ``k`` most frequent values with counts, over all days.

    Counts are exact while no more values than some three quarters of twice the ``capacity`` came; else off by :func:`top_error` of all rows at most.
    """
    merged = sketches.groupBy(by).agg(F.hll_union_agg("distinct_sketch").alias("d"), F.expr(f"approx_top_k_combine(top_sketch, {capacity})").alias("t"))
    return merged.select(by, F.hll_sketch_estimate("d").alias("n_distinct"), F.expr(f"approx_top_k_estimate(t, {k})").alias("top"))


def top_error(capacity: int = 1024) -> float:
    """The share of all rows by which a sketch's count of a value is off at most: that of frequent-items sketches, of 4/3 of the capacity rounded up to a power of 2."""
    return 3.5 / 2 ** math.ceil(math.log2(capacity / 0.75))


def alike(rows: DataFrame, column: str, collation: str = "UNICODE_CI_AI") -> DataFrame:
    """first, n, spellings of the values that a collation takes for equal, in its order; ``first`` is the least by code points."""
    word = F.col(column)
    grouped = rows.groupBy(F.collate(word, collation).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.collate(word, "UTF8_BINARY")).alias("spellings"), F.min(F.collate(word, "UTF8_BINARY")).alias("first"))
    return grouped.orderBy("w").select("first", "n", "spellings")
