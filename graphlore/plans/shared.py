"""Tables written to the folder that the driver and every executor share.

Lineage is cut by a written table, never by block storage on executors, so
a lost executor costs a re-read and not the job.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
#: Paths handed out inside the innermost :func:`tables` of this thread or task.
_own: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("graphlore_tables", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local one, in local mode only: a cluster's executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphlore-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed when the driver exits."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    if (own := _own.get()) is not None:
        own.append((spark, path))
    return path


@contextmanager
def tables() -> Iterator[Callable[[DataFrame], None]]:
    """The tables written inside, in this thread, as a scope of their own.

    Gives a function that deletes all of them but the one it is called with;
    tables of other scopes, such as a second pipeline's, are not touched.
    """
    own: list[tuple[SparkSession, str]] = []
    token = _own.set(own)

    def keep_only(table: DataFrame) -> None:
        for spark, path in own:
            if path != table._shared_path:
                _delete(spark, path)

    try:
        yield keep_only
    finally:
        _own.reset(token)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it.

    Shuffle files go when the driver collects the plan that made them, so
    that is asked for here: the next stage then has their disk.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    scan = spark.read.schema(schema).parquet(path)
    scan._shared_path = path
    return scan


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote and nothing reads any more."""
    _delete(table.sparkSession, table._shared_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _place():
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def located(df: DataFrame, name: str = "_locator") -> DataFrame:
    """``df`` with the file and row that hold each row's content; what is not a plain Parquet scan is written first."""
    if "_metadata" not in df.columns:
        try:
            return df.withColumn(name, _place())
        except AnalysisException:
            pass
    return cut(df.drop("_metadata"), "located").withColumn(name, _place())


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The columns ``needed``, each row's place as ``_locator`` and the whole row as ``_doc``, whatever its columns are called."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc")
    if "_metadata" not in df.columns:
        try:
            return df.select(whole, *needed, _place().alias("_locator"))
        except AnalysisException:
            pass
    return cut(df.select(whole, *needed), "located").withColumn("_locator", _place())


def _number(setting: str) -> int:
    """A setting's number, in bytes if it has a unit of size; 0 if it has none that is known."""
    found = re.fullmatch(r"(\d+)([bkmg]?)b?", setting.strip().lower())
    return int(found[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[found[2]] if found else 0


def bound_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Keep Arrow batches small where texts may be very long.

    Results are computed after the operator has returned, so the session
    keeps these limits; they only ever get smaller.
    """
    for key, most, unit in (("maxRecordsPerBatch", rows, ""), ("maxBytesPerBatch", mb << 20, "b")):
        name = f"spark.sql.execution.arrow.{key}"
        now = _number(spark.conf.get(name))
        if now <= 0 or now > most:
            spark.conf.set(name, f"{most}{unit}")


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the cluster's own clean-up has the folder
            continue
