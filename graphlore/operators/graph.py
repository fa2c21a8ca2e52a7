"""Bounded traversal of the link graph and of the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reachable(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, depth: nodes up to ``depth`` directed hops from ``seeds`` (node), each at its least depth.

    ``links``: src, dst. Depth is 1 to 3, so lineage stays short; every hop
    is a join of the frontier, and visited nodes leave by an anti join.
    """
    if depth not in (1, 2, 3):
        raise ValueError("depth is 1, 2 or 3")
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("bigint"))
    frontier = seen.select("node")
    for d in range(1, depth + 1):
        new = frontier.withColumnRenamed("node", "src").join(links.select("src", "dst"), "src").select(F.col("dst").alias("node")).distinct()
        frontier = new.join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d).cast("bigint")))
    return seen


def neighbourhood(sections: DataFrame, links: DataFrame, article: str, depth: int = 2, limit: int = 50, category: str | None = None) -> DataFrame:
    """article, depth: articles around one, in the order of depth and title. The category holds for what is returned, not for what is passed."""
    seeds = sections.filter(F.col("article") == article).select(F.col("id").alias("node"))
    found = reachable(links, seeds, depth).join(sections.select(F.col("id").alias("node"), "article", "category"), "node")
    found = found.groupBy("article", "category").agg(F.min("depth").alias("depth"))
    if category is not None:
        found = found.filter(F.col("category") == category)
    return found.orderBy("depth", "article").limit(limit).select("article", "depth")


def article_links(sections: DataFrame, links: DataFrame) -> DataFrame:
    """source, target: distinct pairs of linked articles."""
    a = sections.select(F.col("id").alias("src"), F.col("article").alias("source"))
    b = sections.select(F.col("id").alias("dst"), F.col("article").alias("target"))
    return links.join(a, "src").join(b, "dst").select("source", "target").distinct()


def edges_among(pairs: DataFrame, nodes: DataFrame, limit: int = 1000) -> DataFrame:
    """source, target, link_type, weight of article pairs whose ends are both in ``nodes`` (article)."""
    own = nodes.select("article")
    kept = pairs.join(own, pairs["source"] == own["article"], "left_semi").join(own, pairs["target"] == own["article"], "left_semi")
    return kept.orderBy("source", "target").limit(limit).select("source", "target", F.lit("internal").alias("link_type"), F.lit(1.0).alias("weight"))


def either_way(edges: DataFrame) -> DataFrame:
    """a, b: both directions of source, target."""
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).distinct()


def co_occurrence(has_entity: DataFrame, around: DataFrame) -> DataFrame:
    """a, b: other entities in the articles of the entities ``around`` (a). Only the articles of the frontier are joined."""
    held = around.join(has_entity.withColumnRenamed("entity_id", "a"), "a")
    return held.join(has_entity.withColumnRenamed("entity_id", "b"), "article").filter("a <> b").select("a", "b").distinct()


def entity_walk(neighbours, seed, depth: int = 1, limit: int = 50, kinds: DataFrame | None = None, kind: str | None = None, spark=None) -> DataFrame:
    """entity_id, depth: breadth-first, each node's neighbours in the order of their names and at most ``limit`` of them.

    ``neighbours(frontier)`` gives a, b for a frontier (a). A type also prunes
    the walk, as only nodes of that type enter the frontier; the seed stays.
    """
    if depth not in (1, 2, 3):
        raise ValueError("depth is 1, 2 or 3")
    frontier = spark.createDataFrame([(seed,)], f"a {'bigint' if isinstance(seed, int) else 'string'}")
    seen = frontier.select(F.col("a").alias("entity_id"), F.lit(0).cast("bigint").alias("depth"))
    for d in range(1, depth + 1):
        near = neighbours(frontier)
        if kind is not None:
            near = near.join(kinds.filter(F.col("type") == kind).select(F.col("entity_id").alias("b")), "b")
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter(F.col("n") <= limit)
        new = near.select(F.col("b").alias("entity_id")).distinct().join(seen, "entity_id", "left_anti")
        seen = seen.unionByName(new.withColumn("depth", F.lit(d).cast("bigint")))
        frontier = new.select(F.col("entity_id").alias("a"))
    return seen.orderBy("depth", "entity_id").limit(limit)


def co_occurrence_edges(has_entity: DataFrame, nodes: DataFrame) -> DataFrame:
    """source < target, relation, weight: how many articles two of the ``nodes`` (entity_id) share."""
    held = has_entity.join(nodes.select("entity_id"), "entity_id", "left_semi")
    a, b = held.withColumnRenamed("entity_id", "source"), held.withColumnRenamed("entity_id", "target")
    pairs = a.join(b, "article").filter("source < target")
    return pairs.groupBy("source", "target").agg(F.countDistinct("article").alias("weight")).select("source", "target", F.lit("co_occurs").alias("relation"), "weight")


def relation_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target, relation, weight: distinct directed relations whose ends are both in ``nodes`` (entity_id)."""
    own = nodes.select("entity_id")
    kept = relations.join(own, relations["source"] == own["entity_id"], "left_semi").join(own, relations["target"] == own["entity_id"], "left_semi")
    return kept.select("source", "target", "relation").distinct().withColumn("weight", F.lit(1).cast("bigint"))


def decorated(nodes: DataFrame, has_entity: DataFrame) -> DataFrame:
    """Nodes of a walk with ``articles_count``: how many articles mention each, 0 where none does."""
    held = has_entity.join(nodes.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("entity_id").agg(F.countDistinct("article").alias("articles_count"))
    return nodes.join(held, "entity_id", "left").withColumn("articles_count", F.coalesce("articles_count", F.lit(0).cast("bigint")))


def resolve_mode(mode: str, relations: DataFrame | None) -> str:
    """``auto`` means relations where there are any, else co-occurrence."""
    if mode != "auto":
        return mode
    return "relation" if relations is not None and not relations.isEmpty() else "cooccurrence"


def crawl(pages: DataFrame, page_links: DataFrame, seeds: DataFrame, max_depth: int = 1, max_pages: int = 50) -> DataFrame:
    """page, depth, position: first-in first-out crawl with each page once.

    ``page_links``: page, index, target. Pages that are not there are skipped
    and not counted. Order: depth, the order of the parent, the link's index.
    """
    order = Window.orderBy("parent", "index", "page")
    queue = seeds.select("page", F.lit(0).cast("bigint").alias("parent"), F.col("index").cast("bigint"))
    seen = None
    for depth in range(max_depth + 1):
        first = queue.groupBy("page").agg(F.min(F.struct("parent", "index")).alias("at")).select("page", "at.parent", "at.index")
        level = first.join(pages.select("page"), "page", "left_semi")
        if seen is not None:
            level = level.join(seen.select("page"), "page", "left_anti")
        # cut to what may be returned before rows are numbered in one place
        level = level.orderBy("parent", "index", "page").limit(max_pages)
        level = level.withColumn("turn", F.row_number().over(order).cast("bigint")).withColumn("depth", F.lit(depth).cast("bigint"))
        level = level.select("page", "depth", "turn")
        seen = level if seen is None else seen.unionByName(level)
        queue = level.join(page_links, "page").select(F.col("target").alias("page"), F.col("turn").alias("parent"), F.col("index").cast("bigint"))
    n = F.row_number().over(Window.orderBy("depth", "turn")).cast("bigint")
    seen = seen.orderBy("depth", "turn").limit(max_pages)
    return seen.withColumn("position", n).filter(F.col("position") <= max_pages).select("page", "depth", "position")


def discover(pages: DataFrame, page_links: DataFrame, seeds: DataFrame, max_depth: int = 1, max_pages: int = 50) -> DataFrame:
    """What a :func:`crawl` finds beyond its seeds, with the numbers of seeds and of pages found on each row."""
    walked = crawl(pages, page_links, seeds, max_depth, max_pages)
    counts = walked.agg(F.count_if(F.col("depth") == 0).alias("seeds"), F.count_if(F.col("depth") > 0).alias("discovered"))
    return walked.filter("depth > 0").join(F.broadcast(counts))
