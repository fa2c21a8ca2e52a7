"""Exact deduplication by stateful streaming.

A stream of (digest, document id, content locator) feeds a keyed aggregation
whose state lives in RocksDB, on the executors' disks with snapshots in the
shared folder, and never expires: there is no watermark. For each digest the
state retains how many rows had it and the identifier and locator of the one
that stays, the greatest. After the stream has taken all there is, the state
is read as a table. Every row whose digest was met before is compared byte
by byte with the text that stays; where bytes differ under one digest, those
rows are grouped by their texts instead.

Defined results: a null text equals the empty one; among repeated rows with
one doc_id the one with the greatest locator stays; null doc_ids are less
than any other; an empty table gives an empty result; further columns are
ignored, or passed on by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlore.plans.shared import cut, fresh_path, located, packed

_STORE = "spark.sql.streaming.stateStore"
#: State on disk; only changes are uploaded, no space is set aside, a task's store is closed when it has committed,
#: and all stores of an executor share a small bounded memory.
SETTINGS = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "128",
    f"{_STORE}.rocksdb.writeBufferSizeMB": "4",
    f"{_STORE}.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def stream_state(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state that a stream over ``slim`` leaves, and ``slim`` as it was written for the stream."""
    spark = slim.sparkSession
    source = fresh_path(spark, "dedup-landing")
    at = fresh_path(spark, "dedup-state")
    slim.write.parquet(source)
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(slim.schema).parquet(source)
        kept = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
        query = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
        state = cut(spark.read.format("statestore").load(at), "dedup-state-read")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return state, spark.read.schema(slim.schema).parquet(source)



def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each document: doc_id, locator, digest, keep_id, keep_locator, group_size, kept."""
    return _groups(located(docs.select("doc_id", "text")), digest)


def _groups(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """:func:`exact_groups` of rows whose place is ``_locator``.

    Rows of a group that holds a third of all texts are counted before the
    shuffle; its members meet the one that stays in a join whose hot side
    adaptive execution can split.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("_locator").alias("locator"))
    docs = docs.withColumn("digest", digest(F.col("text")))
    state, slim = stream_state(docs.select("doc_id", "locator", "digest"))
    stays, size = _state_fields(state)
    copies = state.filter(size > 1).select(F.col("key.digest").alias("digest"), stays["doc_id"].alias("keep_id"), stays["locator"].alias("keep_locator"), size.alias("group_size"))
    copies = cut(copies, "dedup-copies")
    # merge joins whatever the sizes: a side that fits a broadcast here does not at scale, and hot digests are split
    hits = docs.select("digest", "locator", "text").join(copies.hint("merge"), "digest").select("digest", "locator", "keep_locator", "text")
    hits = cut(hits, "dedup-hits")
    staying = hits.filter("locator = keep_locator").select("digest", F.col("text").alias("keep_text"))
    # written before duplicates go, as an aggregate on the join's key would keep its hot digests in one task
    differing = hits.join(staying.hint("merge"), "digest").filter(F.col("text") != F.col("keep_text")).select("digest")
    differing = cut(differing, "dedup-differing").distinct()
    out = ["doc_id", "locator", "digest", "keep_id", "keep_locator", "group_size", "kept"]
    single = F.col("group_size").isNull()
    found = slim.join(copies.hint("merge"), "digest", "left").withColumns({
        "keep_id": F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")),
        "keep_locator": F.coalesce("keep_locator", "locator"),
        "group_size": F.coalesce("group_size", F.lit(1).cast("bigint")),
    }).withColumn("kept", F.col("locator") == F.col("keep_locator")).select(*out)
    if differing.isEmpty():
        return found
    apart = docs.join(differing, "digest", "left_semi")
    groups = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    regrouped = apart.join(groups, ["digest", "text"]).select(
        "doc_id", "locator", "digest", F.col("stays.doc_id").alias("keep_id"), F.col("stays.locator").alias("keep_locator"), "group_size", (F.col("locator") == F.col("stays.locator")).alias("kept"))
    return found.join(differing, "digest", "left_anti").unionByName(regrouped)


def _state_fields(state: DataFrame) -> tuple[Column, Column]:
    """The aggregation's two buffers: what stays and the count."""
    fields = state.schema["value"].dataType.fields
    stays = next(f.name for f in fields if f.dataType.typeName() == "struct")
    size = next(f.name for f in fields if f.dataType.typeName() == "long")
    return F.col("value")[stays], F.col("value")[size]


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The documents that stay, with their own columns."""
    docs = packed(docs, "doc_id", "text")
    dropped = _groups(docs, digest).filter(~F.col("kept")).select(F.col("locator").alias("_locator"))
    return docs.join(cut(dropped, "dedup-dropped").hint("merge"), "_locator", "left_anti").select("_doc.*")
