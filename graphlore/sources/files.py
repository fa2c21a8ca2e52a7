"""Sources that are plain files: trees of JSON records, lists of addresses, evaluation questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "id string, question string, answer string, skill string"


def json_tree(spark: SparkSession, root: str, pattern: str = "CVE-*.json", year: int | None = None, limit: int | None = None) -> DataFrame:
    """path, name, payload of the files below a folder whose names fit, in the order of their names.

    ``year``: only names that have it after their first part. ``limit``: the
    first so many by name.
    """
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    rows = texts.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("payload"))
    if year is not None:
        rows = rows.filter(F.col("name").rlike(f"^[A-Za-z]+-{int(year)}-"))
    rows = rows.orderBy("name", "path")
    return rows if limit is None else rows.limit(limit)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """position, url: the lines of a list of seeds that are neither blank nor comments, each address once."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("i"), F.trim(F.regexp_replace("value", "\\s+$", "")).alias("url"))
    kept = rows.filter((F.col("url") != "") & ~F.startswith("url", F.lit("#"))).groupBy("url").agg(F.min("i").alias("position"))
    return kept.select("position", "url").orderBy("position")


def questions(spark: SparkSession, path: str | None = None, table: DataFrame | None = None, rows: list[tuple] | None = None) -> DataFrame:
    """id, question, answer, skill from exactly one of a file of JSON lines, a table, or rows given as they are.

    Lines that are no JSON, and questions without id or text, are errors; so
    are repeated ids.
    """
    given = [x is not None for x in (path, table, rows)]
    if sum(given) != 1:
        raise ValueError("questions come from exactly one of a path, a table and rows")
    if path is not None:
        lines = spark.read.text(path).filter(F.trim("value") != "")
        v = F.try_parse_json("value")
        found = lines.select(*[F.try_variant_get(v, f"$.{c}", "string").alias(c) for c in ("id", "question", "answer", "skill")])
    else:
        found = table if table is not None else spark.createDataFrame(rows, QUESTION)
        found = found.select(*[F.col(c).cast("string").alias(c) for c in ("id", "question", "answer", "skill")])
    bad = found.agg(F.count_if(F.expr("id is null or question is null or trim(question) = ''")).alias("unreadable"), (F.count("id") - F.countDistinct("id")).alias("repeated")).first()
    if bad["unreadable"] or bad["repeated"]:
        raise ValueError(f"questions are rejected: {bad.asDict()}")
    return found
