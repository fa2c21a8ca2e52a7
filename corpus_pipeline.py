"""A corpus from raw documents to token ids: filter, deduplicate twice, mix and encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's documents. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlore.llm import exact_dedup, mixing, near_join, quality_rules, sentencepiece_codec
from graphlore.plans.shared import cut, tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the greatest doc_id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, five-word shingles at a similarity of 0.8, the one with the least doc_id."""
    return near_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, whole, repeated as often as their share rounds to; each source comes near its target."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and digests of them and of the text that they decode to."""
    done = sentencepiece_codec.round_trip(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return done.select(
        "doc_id", "lang", "source", "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]
#: Sketches, shingle classes, seeded blocks and tokens are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with tables() as keep_only:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep_only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
