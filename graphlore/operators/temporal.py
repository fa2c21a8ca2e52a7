"""Joins by time: the last row before, and rows within an interval. Keys are parted by time, so that a busy one is not one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def _seconds(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, tie: str, width: int = DAY) -> DataFrame:
    """``left`` with ``found``: the last row of ``right`` (a struct of its columns beside ``by``) of the same key at or before its time, null if there is none.

    Rows are dealt by key and stretch of ``width`` seconds. The last row of
    each stretch is carried into later ones, which takes a row a key and
    stretch. Of rows at one time the one with the greatest ``tie`` counts. A
    null key meets a null key, as in a window; a null time is before all
    others and finds only such.
    """
    stretch = F.floor(_seconds(at) / width).alias("_stretch")
    rest = [c for c in right.columns if c not in by]
    held = right.select(*by, stretch, F.col(at).alias("_at"), F.struct(F.col(at).alias("_t"), F.col(tie).alias("_k"), F.struct(*rest).alias("found")).alias("_row"), F.lit(None).cast(_kind(left)).alias("_left"))
    asked = left.select(*by, stretch, F.col(at).alias("_at"), F.lit(None).cast(held.schema["_row"].dataType).alias("_row"), F.struct(*left.columns).alias("_left"))
    inside = Window.partitionBy(*by, "_stretch").orderBy(F.asc_nulls_first("_at"), F.col("_row").isNull(), "_row._k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = held.unionByName(asked).withColumn("_own", F.last("_row", ignorenulls=True).over(inside)).filter("_left is not null")
    # what each stretch is given by those before it
    ends = held.groupBy(*by, "_stretch").agg(F.max("_row").alias("_row")).unionByName(asked.select(*by, "_stretch").distinct().withColumn("_row", F.lit(None).cast(held.schema["_row"].dataType)))
    ends = ends.groupBy(*by, "_stretch").agg(F.max("_row").alias("_row"))
    earlier = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_row", ignorenulls=True).over(earlier)).select(*[F.col(c).alias(f"_{k}") for k, c in enumerate([*by, "_stretch"])], "_carried")
    same = [own[c].eqNullSafe(carried[f"_{k}"]) for k, c in enumerate([*by, "_stretch"])]
    joined = own.join(carried, same, "left")
    return joined.select("_left.*", F.coalesce(F.col("_own.found"), F.col("_carried.found")).alias("found"))


def _kind(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("x")).schema["x"].dataType


def within(left: DataFrame, right: DataFrame, by: list[str], at: str, before: int, after: int = 0) -> DataFrame:
    """Pairs (``l``, ``r``: structs) of the same key, ``r`` from ``before`` seconds before to ``after`` seconds after ``l``, ends included.

    A right row lies in one stretch as long as the interval, a left row asks
    the two or three that its interval touches. Null keys and times meet
    nothing.
    """
    width = max(before + after, 1)
    r = right.select(*by, F.floor(_seconds(at) / width).alias("_stretch"), F.struct(*right.columns).alias("r"))
    low, high = (_seconds(at) - before) / width, (_seconds(at) + after) / width
    touched = left.filter(F.col(at).isNotNull()).select(*by, F.explode(F.sequence(F.floor(low), F.floor(high))).alias("_stretch"), F.struct(*left.columns).alias("l"))
    apart = F.unix_micros(F.col(f"r.{at}").cast("timestamp")) - F.unix_micros(F.col(f"l.{at}").cast("timestamp"))
    return touched.join(r, [*by, "_stretch"]).filter(apart.between(-before * 1_000_000, after * 1_000_000)).select("l", "r")
