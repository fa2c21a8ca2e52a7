"""A pack written by micro-batches under a commit log: readers see whole batches only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlore.operators.incremental import both_ends, first_wins
from graphlore.plans.shared import cut

ARTICLE = "title string, position bigint, content string, entities array<struct<entity_id:string,name:string>>, links array<string>, relations array<struct<source:string,target:string,relation:string>>"


class Fenced(RuntimeError):
    """Another writer has taken the folder over."""


class PackWriter:
    """Writes batches of articles with their entities, links and relations.

    A batch is written to a folder that no one else knows, then one file of
    its number is created in the commit log, which fails if it is there. A
    reader takes the folders that the log names, so a batch that was torn is
    not seen, whether or not it is repeated, and one that is repeated after
    its commit is left alone. Opening a folder to write raises its epoch;
    a writer of an earlier epoch can commit nothing more.

    A batch costs what its own rows cost, which are written as they come:
    titles and entities that are there several times, in one batch or in
    several, are settled when they are read, the earliest batch's and there
    the first position's first. Links and relations are taken then too, as
    their ends may come later.

    Batches: title, position, content, entities (array of entity_id, name),
    links (array of titles), relations (array of source, target, relation).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._epoch: int | None = None

    # files ---------------------------------------------------------------------------------------

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, path: str) -> list[str]:
        fs, target = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def _create(self, path: str, text: str, over: bool = False) -> bool:
        """Create a small file, if it is not there or ``over`` it; whether it was created."""
        fs, target = self._fs(path)
        try:
            out = fs.create(target, over)
        except Exception as e:  # raised by the file system when there is one
            if fs.exists(target):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, path: str) -> dict:
        """What a small file says; nothing if its writer was lost before it was closed."""
        fs, target = self._fs(path)
        stream = fs.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return {}
        finally:
            stream.close()

    # the log -------------------------------------------------------------------------------------

    def _newest(self) -> int:
        return max((int(n) for n in self._names("epochs")), default=0)

    def open(self) -> PackWriter:
        """Take the folder over for writing; done by the first write."""
        while True:
            self._epoch = self._newest() + 1
            if self._create(f"epochs/{self._epoch:012d}", "{}"):
                return self

    def commits(self) -> dict[int, str]:
        """Committed batches and the folder of each: one file a batch, read by the driver."""
        found = {int(n): self._read(f"commits/{n}") for n in self._names("commits")}
        return {n: x["folder"] for n, x in found.items() if "folder" in x}

    def batches(self) -> int:
        """How many batches are stored whole: where a resumed run goes on."""
        return len(self.commits())

    # writing -------------------------------------------------------------------------------------

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """One batch; as the function of a stream's ``foreachBatch`` or called by hand."""
        if self._epoch is None:
            self.open()
        commit = f"commits/{batch_id:012d}"
        begun = commit.split("/")[1] in self._names("commits")
        if begun and "folder" in self._read(commit):
            return
        place = f"batches/{batch_id:012d}-{uuid.uuid4().hex}"
        self._put(batch, place)
        if self._newest() != self._epoch:
            raise Fenced(f"{self.folder} is written by another writer now")
        if not self._create(commit, json.dumps({"folder": place, "epoch": self._epoch}), over=begun):
            raise Fenced(f"batch {batch_id} was committed by another writer")

    def _put(self, batch: DataFrame, place: str) -> None:
        batch.filter("title is not null").select("title", "position", "content", "entities", "links", "relations").write.parquet(f"{self.folder}/{place}")

    def stream(self, source: DataFrame, checkpoint: str):
        """Write a stream of such rows; the caller awaits the query."""
        return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(self.write).start()

    # reading -------------------------------------------------------------------------------------

    def _articles(self, upto: int | None) -> DataFrame:
        """Every article of committed batches (with a number below ``upto``), with the batch that it is taken from.

        Only titles are shuffled to find those that are there several times, and whole rows of these alone to settle them.
        """
        found = {n: f"{self.folder}/{p}" for n, p in self.commits().items() if upto is None or n < upto}
        if not found:
            return self.spark.createDataFrame([], f"{ARTICLE}, batch bigint")
        rows = self.spark.read.schema(ARTICLE).parquet(*found.values())
        rows = rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batches/(\d+)-", 1).cast("bigint"))
        # written, so that its size is known: a short list goes to the tasks, a long one is joined by a shuffle
        again = cut(rows.groupBy("title").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("title"), "titles-again")
        settled = first_wins(rows.join(again, "title", "left_semi"), ["title"], ["batch", "position"])
        return rows.join(again, "title", "left_anti").unionByName(settled)

    @staticmethod
    def _others(article: DataFrame, write=lambda name, table: table) -> dict[str, DataFrame]:
        """The tables that follow from the articles, each as ``write`` gives it back; an article has its title alone, so what it repeats is found within its row."""
        each = article.select("title", "batch", "position", F.posexplode("entities").alias("at", "e")).select("title", "batch", "position", "at", "e.entity_id", "e.name").filter("entity_id is not null")
        entity = write("entity", first_wins(each, ["entity_id"], ["batch", "position", "at"]).select("entity_id", "name", F.col("title").alias("first_article")))
        mentioned = F.array_distinct(F.transform("entities", lambda e: e["entity_id"]))
        has_entity = article.select(F.col("title").alias("article"), F.explode(mentioned).alias("entity_id")).filter("entity_id is not null")
        links = article.select(F.col("title").alias("source"), F.explode(F.array_distinct("links")).alias("target")).filter("source <> target")
        relations = article.select(F.explode(F.array_distinct("relations")).alias("r")).select("r.*").distinct()
        return {
            "entity": entity, "has_entity": write("has_entity", has_entity),
            "links": write("links", both_ends(links, article, "title", ("target",))), "entity_relation": write("entity_relation", both_ends(relations, entity, "entity_id")),
        }

    def snapshot(self, upto: int | None = None) -> dict[str, DataFrame]:
        """The tables as of the commits there are now (with a number below ``upto``); later batches don't change them."""
        article = self._articles(upto)
        return {"article": article.drop("batch"), **self._others(article)}

    def stored(self, table: str) -> DataFrame | None:
        """A table of the snapshot of now; None before the first commit."""
        return self.snapshot()[table] if self.batches() else None

    def finish(self) -> str:
        """Write the snapshot as a pack, in one bulk load; its folder, which has its name when it is whole."""
        name = f"{self.batches():012d}-{uuid.uuid4().hex}"
        staging, place = f"staging/{name}", f"packs/{name}"

        def write(table: str, rows: DataFrame) -> DataFrame:
            rows.write.parquet(f"{self.folder}/{staging}/{table}")
            return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{staging}/{table}")

        # further tables follow from what was written, not from the batches once more
        self._others(write("article", self._articles(None)), write)
        (fs, source), (_, target) = self._fs(staging), self._fs(place)
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"{place} could not be published")
        return f"{self.folder}/{place}"
