"""Score fusion: hybrid and lexical retrieval, reranking, unions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlore.functions.columns import strip
from graphlore.operators.graph import reachable
from graphlore.operators.vectors import vector_retrieve

WEIGHTS = (0.5, 0.3, 0.2)
#: Scores of a neighbour and of a title match before their weight; how many seeds and keywords count.
NEIGHBOUR, KEYWORD, SEEDS, KEYWORDS = 0.5, 0.7, 3, 3
TERMS, TERM_ROWS = 12, 200

#: Words that are no keywords; fixed values.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "shall", "can", "not", "no", "nor", "so", "yet", "both", "either", "neither", "as", "if", "then", "than",
    "that", "this", "these", "those", "it", "its", "i", "we", "you", "he", "she", "they", "me", "us", "him", "her",
    "them", "my", "our", "your", "his", "their", "what", "which", "who", "whom", "when", "where", "why", "how", "all", "any",
    "each", "few", "more", "most", "other", "some", "such",
)


def keywords(question: Column) -> Column:
    """The first three words of more than three letters that are no stop words."""
    words = F.split(F.trim(F.regexp_replace(question, r"\s+", " ")), " ")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*STOP_WORDS)), 1, KEYWORDS)


def lexical_terms(question: Column) -> Column:
    """The whole phrase, then its parts of two or more characters, distinct, twelve at most."""
    phrase = strip(F.lower(question))
    parts = F.filter(F.split(phrase, r"[\s/@:;,]+"), lambda w: F.length(w) >= 2)
    return F.slice(F.array_distinct(F.filter(F.concat(F.array(phrase), parts), lambda w: F.length(w) >= 2)), 1, TERMS)


def _added(signals: list[DataFrame]) -> DataFrame:
    """Signals (id, delta, step, pos) added by id; the earliest row breaks ties."""
    every = reduce(DataFrame.unionByName, signals)
    return every.groupBy("id").agg(F.sum("delta").alias("score"), F.min(F.struct("step", "pos", "sub")).alias("seen"))


def hybrid_retrieve(sections: DataFrame, links: DataFrame, query: DataFrame, words: list[str], k: int, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """id, score, rank: vector hits, neighbours of the first three and title matches of keywords, weighted and added.

    Repeated links and repeated keywords add again. ``LIMIT k`` of the
    neighbour and keyword lists is by id, which makes them repeatable.
    """
    near = vector_retrieve(sections, query, k)
    vector = near.select("id", (weights[0] * F.col("score")).alias("delta"), F.lit(0).alias("step"), F.col("rank").alias("pos"), F.lit(0).cast("bigint").alias("sub"))
    seeds = near.filter(F.col("rank") <= SEEDS).select(F.col("id").alias("src"), "rank")
    out = links.join(F.broadcast(seeds), "src").join(sections.select(F.col("id").alias("dst")), "dst")
    turn = F.row_number().over(Window.partitionBy("rank").orderBy("dst"))
    graph = out.select(F.col("dst").alias("id"), "rank", turn.alias("n")).filter(F.col("n") <= k)
    graph = graph.select("id", F.lit(weights[1] * NEIGHBOUR).alias("delta"), F.lit(1).alias("step"), F.col("rank").alias("pos"), F.col("n").cast("bigint").alias("sub"))
    signals = [vector, graph]
    if words:
        # one scan for all keywords; the rank's limit is applied before the shuffle
        said = [F.when(F.contains(F.lower("title"), F.lit(word.lower())), F.lit(i).cast("bigint")) for i, word in enumerate(words[:KEYWORDS])]
        hit = sections.select("id", F.explode(F.array_compact(F.array(*said))).alias("pos"))
        n = F.row_number().over(Window.partitionBy("pos").orderBy("id")).cast("bigint")
        hit = hit.select("id", "pos", n.alias("sub")).filter(F.col("sub") <= k)
        signals.append(hit.select("id", F.lit(weights[2] * KEYWORD).alias("delta"), F.lit(2).alias("step"), "pos", "sub"))
    return ranked(_added(signals), k)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of id, score, seen: by score, then by what was seen first, then id."""
    order = [F.desc(F.round("score", 9)), F.col("seen"), F.col("id")]
    top = scores.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select("id", "score", "rank")


def contains_any(fields: list[str], term: Column) -> Column:
    """Whether a lower-case term is literally inside one of the fields."""
    return reduce(or_, [F.coalesce(F.contains(F.lower(F.col(f)), term), F.lit(False)) for f in fields])


def lexical_retrieve(rows: DataFrame, question: str, fields: list[str], k: int) -> DataFrame:
    """id, score, rank: share of the question's terms found, at most 200 rows counted a term (by id).

    Terms are twelve at most, so each row is read once and tested against all.
    """
    missing = [f for f in fields if f not in rows.columns]
    if missing:
        raise ValueError(f"the pack has no columns {missing}; lexical search needs a newer one")
    terms = lexical_terms(F.lit(question))
    hits = rows.select("id", F.posexplode(terms).alias("t", "term"), *fields).filter(contains_any(fields, F.col("term"))).select("id", "t")
    first = F.row_number().over(Window.partitionBy("t").orderBy("id"))
    # a bounded list for each term: the window keeps no more than that many rows of a group
    counted = hits.withColumn("n", first).filter(F.col("n") <= TERM_ROWS)
    total = F.size(terms).cast("double")
    scores = counted.groupBy("id").agg((F.countDistinct("t") / total).alias("score"), F.min(F.struct("t", "n")).alias("seen"))
    return ranked(scores, k)


def union_by_max(first: DataFrame, second: DataFrame) -> DataFrame:
    """id, score, source: each id once, with its greater score; the first wins ties."""
    both = first.select("id", "score", F.lit(0).alias("source")).unionByName(second.select("id", "score", F.lit(1).alias("source")))
    best = both.groupBy("id").agg(F.max(F.struct("score", (-F.col("source")).alias("own"))).alias("b"))
    return best.select("id", F.col("b.score").alias("score"), (-F.col("b.own")).alias("source"))


def union_second_wins(first: DataFrame, second: DataFrame) -> DataFrame:
    """id, score, source: each id once; the second's score is taken where it is no less."""
    both = first.select("id", "score", F.lit(0).alias("source")).unionByName(second.select("id", "score", F.lit(1).alias("source")))
    best = both.groupBy("id").agg(F.max(F.struct("score", "source")).alias("b"))
    return best.select("id", "b.score", "b.source")


def graph_rerank(candidates: DataFrame, links: DataFrame, alpha: float = 0.5, seeds: int = 5, hops: int = 1) -> DataFrame:
    """id, score, rank: candidates (id, score, rank) linked, either way, to one of the best five gain half of alpha times its score. No rows are added."""
    if hops != int(hops) or hops > 1:
        raise ValueError("at most one hop")
    if hops < 1:
        return candidates
    best = F.broadcast(candidates.filter(F.col("rank") <= seeds).select(F.col("id").alias("a"), F.col("score").alias("s")))
    either = links.select(F.col("src").alias("a"), F.col("dst").alias("id")).unionByName(links.select(F.col("dst").alias("a"), F.col("src").alias("id")))
    boost = either.join(best, "a").groupBy("id").agg(F.sum(F.col("s") * alpha / 2).alias("boost"))
    scored = candidates.join(boost, "id", "left").select("id", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"), F.struct(F.lit(0).alias("step"), F.col("rank").alias("pos")).alias("seen"))
    order = [F.desc(F.round("score", 9)), F.col("seen.pos"), F.col("id")]
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select("id", "score", "rank")


def overfetch(limit: int) -> int:
    return min(5 * limit, 200)


def seed_neighbours(sections: DataFrame, article: str, limit: int, category: str | None = None, threshold: float = 0.0) -> DataFrame:
    """article, similarity, rank: nearest other articles to an article's lead section; category and threshold apply after the cut."""
    from graphlore.operators.vectors import knn

    lead = sections.filter((F.col("article") == article) & (F.col("section_index") == 0)).select(F.col("embedding").alias("q")).limit(1)
    hits = knn(sections.select("id", "article", "category", "embedding"), lead, overfetch(limit)).filter(F.col("article") != article)
    best = hits.groupBy("article", "category").agg(F.max("similarity").alias("similarity"))
    if category is not None:
        best = best.filter(F.col("category") == category)
    best = best.filter(F.col("similarity") >= threshold)
    order = [F.desc("similarity"), F.col("article")]
    top = best.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select("article", "similarity", "rank")


def semantic_search(sections: DataFrame, articles: DataFrame, summaries: DataFrame, seed: str, k: int, category: str | None = None, threshold: float = 0.0) -> DataFrame:
    """:func:`seed_neighbours` with category, words and summary of each article found; in the order of similarity."""
    found = seed_neighbours(sections, seed, k, category, threshold).select("article", "similarity", "rank")
    detail = articles.select(F.col("title").alias("article"), "category", "word_count")
    joined = found.join(detail, "article", "left").join(summaries, "article", "left")
    return joined.select("article", "category", "word_count", F.coalesce("summary", F.lit("")).alias("summary"), "similarity", "rank")


def seed_hybrid(sections: DataFrame, links: DataFrame, seed: str, k: int = 10, pool: int = 50, depth: int = 2, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """article, score, rank: similarity to a seed article and nearness in the link graph, weighted and added."""
    vec = seed_neighbours(sections, seed, pool).select("article", "similarity")
    start = sections.filter(F.col("article") == seed).select(F.col("id").alias("node"))
    near = reachable(links, start, depth).filter("depth > 0").join(sections.select(F.col("id").alias("node"), "article"), "node")
    prox = near.filter(F.col("article") != seed).groupBy("article").agg(((depth - F.min("depth") + 1) / float(depth)).alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    scored = vec.join(prox, "article", "full_outer").select("article", (weights[0] * zero("similarity") + weights[1] * zero("p")).alias("score"))
    order = [F.desc(F.round("score", 9)), F.col("article")]
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
