"""Digests of keyed rows as a tree: no order to sort by, no group that grows, and two trees show where they differ.

A row's leaf is named by the first hexadecimal digits of its key's digest, so
many that a leaf has some 256 rows whatever the table's size. A node's digest
is over those of its at most sixteen children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlore.plans.shared import cut

LEAF, MOST_DEPTH = 256, 12


def depth_for(rows: int) -> int:
    """Digits after which leaves have ``LEAF`` rows or fewer, in the mean."""
    depth = 0
    while rows > LEAF * 16**depth and depth < MOST_DEPTH:
        depth += 1
    return depth


def digested(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """key (string), h: the digest of each row's ``columns``; equal rows of one key are one with their count."""
    text = F.to_json(F.struct(*columns))
    same = rows.select(F.col(key).cast("string").alias("key"), text.alias("text")).groupBy("key", "text").agg(F.count(F.lit(1)).alias("n"))
    return same.select("key", F.sha2(F.concat_ws("\n", F.col("n").cast("string"), "text"), 256).alias("h"))


def _in_order(by: str, what: str) -> Column:
    held = F.array_sort(F.collect_list(F.struct(by, what)))
    return F.sha2(F.array_join(F.transform(held, lambda x: F.concat_ws(":", x[by], x[what])), "\n"), 256)


def _leaf(depth: int) -> Column:
    return F.substring(F.sha2("key", 256), 1, depth) if depth else F.lit("")


def _leaves(rows: DataFrame, depth: int) -> DataFrame:
    return rows.withColumn("prefix", _leaf(depth)).groupBy("prefix").agg(_in_order("key", "h").alias("digest"), F.count(F.lit(1)).alias("n"))


def _above(nodes: DataFrame, level: int) -> DataFrame:
    up = nodes.select(F.substring("prefix", 1, level).alias("up"), F.substring("prefix", level + 1, 1).alias("digit"), "digest", "n")
    return up.groupBy(F.col("up").alias("prefix")).agg(_in_order("digit", "digest").alias("digest"), F.sum("n").alias("n"))


def levels(rows: DataFrame, depth: int) -> list[DataFrame]:
    """prefix, digest, n of the nodes of each level, the root's first. ``rows``: key, h."""
    found = [_leaves(rows, depth)]
    for level in range(depth - 1, -1, -1):
        found.insert(0, _above(found[0], level))
    return found


def _held_levels(rows: DataFrame, depth: int) -> list[DataFrame]:
    """:func:`levels`, each written once."""
    found = [cut(_leaves(rows, depth), "tree-leaves")]
    for level in range(depth - 1, -1, -1):
        found.insert(0, cut(_above(found[0], level), "tree-nodes"))
    return found


def identity(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """digest, rows: the root over key, h; of no rows the digest of nothing."""
    found = levels(rows, depth_for(rows.count()) if depth is None else depth)[0]
    return found.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"))


def differing(left: DataFrame, right: DataFrame, depth: int | None = None) -> DataFrame:
    """key, problem (missing, unexpected or changed) of rows (key, h) in which ``right`` differs from ``left``.

    Rows and nodes are written once, so that no level makes those below it
    anew. Both trees are descended together: of each level only children of nodes
    that differ are compared, and of the rows only those of leaves that do.
    """
    left, right = cut(left.select("key", "h"), "tree-rows"), cut(right.select("key", "h"), "tree-rows")
    depth = depth_for(max(left.count(), right.count())) if depth is None else depth
    a, b = _held_levels(left, depth), _held_levels(right, depth)
    open_: DataFrame | None = None
    for level in range(depth + 1):
        x, y = (t[level].select("prefix", F.col("digest").alias(name)) for t, name in ((a, "x"), (b, "y")))
        if open_ is not None:
            x, y = (t.join(open_, F.substring(t["prefix"], 1, level - 1) == open_["up"], "left_semi") for t in (x, y))
        open_ = x.join(y, "prefix", "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select(F.col("prefix").alias("up"))
    here = lambda t, name: t.withColumn("up", _leaf(depth)).join(open_, "up", "left_semi").select("key", F.col("h").alias(name))
    both = here(left, "x").join(here(right, "y"), "key", "full").filter(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("key", F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "unexpected").otherwise("changed").alias("problem"))


