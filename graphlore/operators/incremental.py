"""Immutable upserts: reading deltas, classifying, merging, identity and references."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlore.operators import merkle
from graphlore.plans.shared import cut


class DeltaError(ValueError):
    """A delta that is rejected as a whole."""


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    """key, operation, payload of newline-separated JSON: raw records, or envelopes of operation, key and payload.

    Blank lines are skipped. Deletes, unknown operations, unreadable lines,
    missing keys and repeated keys reject the whole file.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line")).filter(F.trim("line") != "")
    v = F.try_parse_json("line")
    field = lambda p: F.try_variant_get(v, p, "string")
    rows = lines.select(
        v.isNotNull().alias("readable"),
        F.coalesce(field("$.operation"), F.lit("upsert")).alias("operation"),
        F.coalesce(field("$.key"), field("$.cveMetadata.cveId"), field("$.payload.cveMetadata.cveId")).alias("key"),
        F.when(field("$.operation").isNotNull(), F.to_json(F.try_variant_get(v, "$.payload", "variant"))).otherwise(F.col("line")).alias("payload"),
        F.upper(F.coalesce(field("$.cveMetadata.state"), field("$.payload.cveMetadata.state"), F.lit(""))).alias("state"),
    )
    bad = rows.agg(F.count_if(~F.col("readable")).alias("unreadable"), F.count_if(F.expr("readable and operation <> 'upsert'")).alias("operation"), F.count_if(F.expr("readable and (key is null or payload is null)")).alias("unmappable"), F.count_if(F.expr("state = 'REJECTED'")).alias("rejected"), (F.count("key") - F.countDistinct("key")).alias("repeated")).first()
    found = {k: n for k, n in bad.asDict().items() if n}
    if found:
        raise DeltaError(f"the delta is rejected: {found}")
    return rows.select("key", "operation", "payload")


def classify(base: DataFrame, delta: DataFrame) -> DataFrame:
    """key, classification: added, unchanged or modified, by the digests of payloads."""
    b = base.select("key", F.sha2("payload", 256).alias("was"))
    d = delta.select("key", F.sha2("payload", 256).alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("was") == F.col("now"), "unchanged").otherwise("modified")
    return d.join(b, "key", "left").select("key", kind.alias("classification"))


def upsert(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Base rows that the delta doesn't name, and the delta's."""
    return base.join(delta.select("key"), "key", "left_anti").unionByName(delta.select(*base.columns))


def identity(delta: DataFrame) -> DataFrame:
    """delta_id, rows: the root of a tree of digests over key, operation and payload, whatever the order and partitions."""
    return merkle.identity(merkle.digested(delta, "key", "operation", "payload")).withColumnRenamed("digest", "delta_id")


def isolate(rows: DataFrame, key: str, column: str, run: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """(done, skipped): ``rows`` with ``value``, what ``run`` makes of a text, and key and error of those at which it fails; one that fails stops no other.

    What is made is written first, so that ``run`` sees each row once.
    """

    @F.pandas_udf("struct<value:string,error:string>")
    def attempt(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((run(t), None))
            except Exception as e:  # the article is skipped, with its reason
                out.append((None, f"{type(e).__name__}: {e}"[:500]))
        return pd.DataFrame(out, columns=["value", "error"])

    tried = cut(rows.withColumn("_made", attempt(F.col(column))), "isolated")
    done = tried.filter("_made.error is null").withColumn("value", F.col("_made.value")).drop("_made")
    return done, tried.filter("_made.error is not null").select(key, F.col("_made.error").alias("error"))


def without(links: DataFrame, skipped: DataFrame, key: str, ends: tuple[str, str] = ("source", "target")) -> DataFrame:
    """Links neither of whose ends was skipped."""
    own = links.columns
    for e in ends:
        links = links.join(skipped.select(F.col(key).alias(e)), e, "left_anti")
    return links.select(*own)


def build_identity(delta_id: DataFrame, pack: str, version: str, base_digest: str, model: str, versions: dict[str, str]) -> DataFrame:
    """delta_id, build_id: the digest of everything that a build follows from, in a fixed order."""
    known = [f"pack={pack}", f"version={version}", f"base={base_digest}", f"model={model}", *(f"{k}={versions[k]}" for k in sorted(versions))]
    return delta_id.select("delta_id", F.sha2(F.concat_ws("\n", *map(F.lit, known), F.concat(F.lit("delta="), "delta_id")), 256).alias("build_id"))


def recompute(base: DataFrame, delta: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, payload, embedding, reused: the rows after a delta. Only added and changed payloads are embedded.

    ``base``: key, payload, embedding; ``delta``: key, payload. ``embed`` adds
    the embedding and sees changed rows alone; unchanged ones, and those that
    the delta doesn't name, keep the vectors of the base.
    """
    changed = delta.select("key", "payload").join(classify(base, delta).filter("classification <> 'unchanged'").select("key"), "key", "left_semi")
    kept = base.select("key", "payload", "embedding").join(changed.select("key"), "key", "left_anti")
    fresh = embed(changed).select("key", "payload", F.col("embedding").cast(base.schema["embedding"].dataType).alias("embedding"))
    return kept.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))


def probe(hits: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """hits, distinct_hits, live_hits, sound: of the ids (query, id) that an index gave for its own vectors, how many are there; sound if every query found k live ids."""
    known = live.select("id").distinct().withColumn("_live", F.lit(1))
    found = hits.join(known, "id", "left")
    counts = found.agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("query", "id").alias("distinct_hits"), F.count("_live").alias("live_hits"), F.countDistinct("query").alias("queries"))
    return counts.select("hits", "distinct_hits", "live_hits", ((F.col("hits") == F.col("distinct_hits")) & (F.col("hits") == F.col("live_hits")) & (F.col("hits") == k * F.col("queries"))).alias("sound"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, of equal ones the least by the other columns in their order. Only the least row of each task is shuffled."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [*order, *rest]])


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def closure(expected: DataFrame, found: DataFrame) -> DataFrame:
    """key, problem: keys that are missing and keys that are too many."""
    missing = expected.select("key").exceptAll(found.select("key")).withColumn("problem", F.lit("missing"))
    return missing.unionByName(found.select("key").exceptAll(expected.select("key")).withColumn("problem", F.lit("unexpected")))


def resume_point(inventory: DataFrame, stored: DataFrame) -> DataFrame:
    """total, stored, matching, resumable: whether what is stored is a beginning of the ordered inventory (key).

    Ranks come from counting smaller keys by range, not from one sorted task:
    a stored key is in its place if no inventory key below the greatest
    stored one is missing and none is strange.
    """
    inv, got = inventory.select("key").distinct(), stored.select("key").distinct()
    top = got.agg(F.max("key").alias("top"))
    below = inv.join(F.broadcast(top)).filter(F.col("key") <= F.col("top")).select("key")
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    counts = n(inv, "total").join(F.broadcast(n(got, "stored"))).join(F.broadcast(n(below.join(got, "key", "left_semi"), "matching"))).join(F.broadcast(n(below, "expected")))
    return counts.select("total", "stored", "matching", ((F.col("matching") == F.col("stored")) & (F.col("expected") == F.col("stored"))).alias("resumable"))


def orphans(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` is no ``key`` of ``keys``."""
    return rows.join(keys.select(F.col(key).alias(column)), column, "left_anti")


def dangling(references: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """reference, value: of each named reference (rows, column, keys, key) the values that no key has. One anti join for each."""
    found = [orphans(rows.select(column), column, keys, key).select(F.lit(name).alias("reference"), F.col(column).cast("string").alias("value")) for name, (rows, column, keys, key) in references.items()]
    return reduce(DataFrame.unionByName, found)


def both_ends(edges: DataFrame, nodes: DataFrame, node: str, ends: tuple[str, str] = ("source", "target")) -> DataFrame:
    """Edges whose ends are both there."""
    own = edges.columns
    for e in ends:
        edges = edges.join(nodes.select(F.col(node).alias(e)), e, "left_semi")
    return edges.select(*own)


def differing(stored: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """key of rows that are not what they are derived to be: missing, strange or with other values."""
    both = stored.select(*derived.columns).exceptAll(derived).unionByName(derived.exceptAll(stored.select(*derived.columns)))
    return both.select(key).distinct()


def publish(tables: dict[str, DataFrame], path: str) -> None:
    """Write all tables to a new folder, then rename it into place; an existing pack is never replaced."""
    spark = next(iter(tables.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, staging = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staging"))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}.staging/{name}.parquet")
    if not fs.rename(staging, target):
        raise OSError(f"{path} could not be published")


def prefix_rank(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("bigint"))
