"""A knowledge pack: articles, sections, links, entities and relations as DataFrames.

``Pack.open`` reads a folder of Parquet tables; ``Pack.derive`` builds the
same tables from the star-schema and document tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each table of a pack.
SCHEMAS = {
    "article": "title string, category string, word_count bigint, expansion_depth bigint",
    "section": "id bigint, article string, section_index bigint, title string, content string, level bigint, embedding array<float>",
    "links_to": "src bigint, dst bigint, link_type string",
    "has_entity": "article string, entity_id string",
    "entity": "entity_id string, name string, type string, description string",
    "entity_relation": "source string, target string, relation string, context string",
}


def word_count(text):
    """Words parted by white space, none in blank or null texts."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]+", " "))
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, " "))).cast("bigint")


@dataclass
class Pack:
    """Lazily derived tables; every table is a plain DataFrame."""

    spark: SparkSession
    folder: str
    derived: bool = True

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Pack:
        return cls(spark, folder, derived=False)

    @classmethod
    def derive(cls, spark: SparkSession, sf_dir: str) -> Pack:
        return cls(spark, sf_dir)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    @cached_property
    def article(self) -> DataFrame:
        """One article for each document, categorised by language."""
        if not self.derived:
            return self.read("article")
        d = self.read("documents")
        return d.select(F.concat(F.lit("doc-"), "doc_id").alias("title"), F.col("lang").alias("category"), word_count(F.col("text")).alias("word_count"), (F.col("doc_id") % 4).alias("expansion_depth"), "doc_id")

    @cached_property
    def section(self) -> DataFrame:
        """One lead section for each document that has an embedding."""
        if not self.derived:
            return self.read("section")
        e, d = self.read("embeddings"), self.read("documents")
        joined = e.join(d, e["vec_id"] == d["doc_id"])
        article = F.concat(F.lit("doc-"), "doc_id")
        return joined.select(F.col("vec_id").alias("id"), article.alias("article"), F.lit(0).cast("bigint").alias("section_index"), article.alias("title"), F.col("text").alias("content"), F.lit(0).cast("bigint").alias("level"), "embedding", "label", F.col("lang").alias("category"))

    @cached_property
    def links_to(self) -> DataFrame:
        """Two links from each section, by a fixed rule over the number of sections; none to itself."""
        if not self.derived:
            return self.read("links_to")
        ids = self.section.select(F.col("id").alias("src"))
        n = ids.agg(F.count(F.lit(1)).alias("n"))
        both = ids.join(F.broadcast(n))
        dst = F.explode(F.array((F.col("src") * 7 + 3) % F.col("n"), (F.col("src") * 13 + 5) % F.col("n")))
        return both.select("src", dst.alias("dst"), F.lit("internal").alias("link_type")).filter("src <> dst")

    @cached_property
    def has_entity(self) -> DataFrame:
        """Orders as articles, parts as the entities that they mention."""
        if not self.derived:
            return self.read("has_entity")
        return self.read("lineitem").select(F.col("l_orderkey").alias("article"), F.col("l_partkey").alias("entity_id")).distinct()

    @cached_property
    def entity(self) -> DataFrame:
        """Parts as entities."""
        if not self.derived:
            return self.read("entity")
        p = self.read("part")
        return p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"))

    @cached_property
    def entity_relation(self) -> DataFrame:
        """part supplied_by supplier, supplier located_in nation, nation part_of region."""
        if not self.derived:
            return self.read("entity_relation")
        name = lambda kind, key: F.concat(F.lit(f"{kind}-"), key)
        supplied = self.read("lineitem").select(name("part", "l_partkey").alias("source"), name("supplier", "l_suppkey").alias("target"), F.lit("supplied_by").alias("relation")).distinct()
        located = self.read("supplier").select(name("supplier", "s_suppkey"), name("nation", "s_nationkey"), F.lit("located_in"))
        part_of = self.read("nation").select(name("nation", "n_nationkey"), name("region", "n_regionkey"), F.lit("part_of"))
        return supplied.union(located).union(part_of)

    def register(self, prefix: str = "") -> list[str]:
        """Make the pack's tables views of the session, for SQL; their names."""
        names = []
        for t in SCHEMAS:
            if not self.derived or hasattr(type(self), t):
                getattr(self, t).createOrReplaceTempView(f"{prefix}{t}")
                names.append(f"{prefix}{t}")
        return names

    def introspect(self) -> DataFrame:
        """table, column and type of every table of a pack, as the tables have them: an opened pack's files, a derived one's plans."""
        rows = []
        for t in SCHEMAS:
            table = getattr(self, t, None)
            if table is None:
                continue
            rows += [(t, f.name, f.dataType.simpleString(), k) for k, f in enumerate(table.schema)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, column_type string, position int")
