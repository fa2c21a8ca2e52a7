"""Streams: request limits by minute, deduplicating writes, replayable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlore.plans.shared import fresh_path

#: One partition of a stream's window.
WINDOW = "1 minute"


def request_windows(events: DataFrame, limit: int, window: str = WINDOW) -> DataFrame:
    """user_id, start, requests, allowed, refused of each window. Batch or stream: the same plan."""
    w = F.window(F.col("ts").cast("timestamp"), window)
    counts = events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    allowed = F.least("requests", F.lit(limit)).cast("bigint")
    return counts.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "requests", allowed.alias("allowed"), (F.col("requests") - allowed).alias("refused"))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is into a Parquet table in the shared folder, and read that."""
    spark = stream.sparkSession
    out, at = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder for each batch: a batch that is repeated replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # as a pattern the path may be one file or a folder of files
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def first_events(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of a stream, each once however often it comes."""
    return stream.select(*keys).dropDuplicates(keys)


def append_new(batch: DataFrame, table: str, keys: list[str]) -> None:
    """Append the rows of a micro-batch whose keys the table lacks; a replay adds nothing."""
    spark = batch.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        batch = batch.join(spark.read.parquet(table).select(*keys), keys, "left_anti")
    batch.dropDuplicates(keys).write.mode("append").parquet(table)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, events, total of each session: events of a user with less than ``gap`` between them.

    As a stream: a session is given out once the latest time of the batches
    before has passed its end by ``late``. An event that by itself would have
    been such a session one batch earlier comes too late and is dropped. As a
    batch: all sessions.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "events", F.round("total", 6).alias("total"))
