"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is measured in words and dealt in blocks of equally many. Targets
follow the weights, but no source gives more than ``max_repeats`` times what
it has: the excess goes to the others by weight until none is above. Blocks
go to sources by highest quotients target / (2 s - 1), then each source's
blocks go to its shards, bounded hash classes of documents, in the same way,
which gives every shard an integer quota of words. Inside a shard documents
are taken whole in a seeded order, each as often as any other give or take
one, and one document at most is taken in part, so that the shard's words are
just its quota and what is kept of a source as whole documents comes near it.

Defined results: null and blank texts have no words and nothing is taken of
them; a null source is a source, the last in order; repeated rows share out
what is taken in either order; an empty table, or one without words, gives
nothing taken; other columns are ignored or, by :func:`mixed_documents`,
passed on. Rows without a doc_id are dealt to shards by the place they were
read from, where there is one, so that many of them do not meet in one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlore.functions.columns import words_of
from graphlore.plans.shared import cut, packed

#: A shard holds about this many words and at most about this many documents.
SHARD_WORDS, SHARD_DOCS = 1_000_000, 20_000
#: Most words in a block; fewer where a source's target is small, so that every target holds this many blocks.
BLOCK_WORDS, BLOCKS_AT_LEAST = 64, 64
#: Up to this many sources their plan is sent to every executor; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def sainte_lague(df: DataFrame, within: list[str], weight: str, house: str, tie: str, seats: str) -> DataFrame:
    """Add ``seats``: how many of a group's ``house`` seats a row gets by highest quotients.

    With n rows in a group a row's seats lie between its share of house - n/2
    and of house + n/2, so about three candidate seats a row are ranked, not
    all of the house.
    """
    w = Window.partitionBy(*within) if within else Window.partitionBy()
    share = F.when(F.sum(weight).over(w) > 0, F.col(weight) / F.sum(weight).over(w)).otherwise(F.lit(0.0))
    df = df.withColumns({"_share": share, "_n": F.count(F.lit(1)).over(w)})
    low = F.greatest(F.lit(0), F.floor(F.col("_share") * (F.col(house) - F.col("_n") / 2) - 0.5) - 1)
    high = F.when(F.col("_share") > 0, F.ceil(F.col("_share") * (F.col(house) + F.col("_n") / 2) + 0.5) + 1).otherwise(F.lit(0))
    df = df.withColumns({"_low": low.cast("bigint"), "_high": high.cast("bigint")})
    df = df.withColumn("_open", F.col(house) - F.sum("_low").over(w))
    seat = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))
    own = [c for c in df.columns if not c.startswith("_")]
    tried = df.select(*own, "_low", "_open", F.explode_outer(seat).alias("_seat"))
    quotient = F.col(weight) / (2 * F.col("_seat") - 1)
    order = Window.partitionBy(*within) if within else Window.partitionBy()
    ranked = tried.withColumn("_rank", F.row_number().over(order.orderBy(quotient.desc_nulls_last(), F.col(tie))))
    won = F.sum((F.col("_seat").isNotNull() & (F.col("_rank") <= F.col("_open"))).cast("bigint"))
    return ranked.groupBy(*own, "_low").agg(won.alias("_won")).select(*own, (F.col("_low") + F.col("_won")).alias(seats))


def source_plan(sized: DataFrame, max_repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """One row for each source: number, size, target, blocks, words in a block and number of shards.

    The windows without a partition run over sources, not documents.
    """
    every = Window.partitionBy()
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"weight": weight, "cap": F.lit(float(max_repeats)) * F.col("source_size")})
    # sources in the order in which their caps bind; each sees what is left by those before it
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every).cast("double")
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", level)
    sources = sources.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source_no"), F.col("level")))).over(every)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(final * F.col("weight"))
    sources = sources.withColumn("target", target)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    block = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(least / BLOCKS_AT_LEAST))), F.lit(1)).cast("bigint")
    sources = sources.withColumn("block", block)
    sources = sources.withColumn("house", F.round(F.sum("target").over(every) / F.col("block")).cast("bigint"))
    shards = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("docs") / SHARD_DOCS)).cast("bigint")
    sources = sources.withColumn("shards", shards).select("source_no", "source", "source_size", "target", "block", "house", "shards")
    return sainte_lague(sources, [], "target", "house", "source_no", "blocks").drop("house")


def times_taken(sizes: np.ndarray, block: int, quota: int, max_repeats: int) -> np.ndarray:
    """Words taken of each of a shard's documents, which are in a seeded order, when ``quota`` blocks are taken."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.zeros(len(sizes), dtype=np.int64)
    rounds, rest = divmod(min(quota * block, max_repeats * total), total)
    taken = rounds * sizes
    whole = int(np.searchsorted(ends, rest, side="right"))
    taken[:whole] += sizes[:whole]
    # what is less than the next document comes from the shortest one that has as much
    piece = rest - int(ends[whole - 1]) if whole else rest
    if piece:
        left = sizes[whole:]
        taken[whole + int(np.argmin(np.where(left >= piece, left, total + 1)))] += piece
    return taken


def whole_copies(sizes: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """How often each document of a shard stands whole for what is taken of it: rounded halves up, but never nothing of a shard that gives something."""
    copies = (2 * taken + sizes) // np.maximum(2 * sizes, 1)
    if taken.any() and not copies.any():
        copies[int(np.argmax(taken))] = 1
    return copies


def _place(docs: DataFrame, row: Column | None) -> Column:
    """A hash of where a row was read from: the place given, else the name of its file and its number there, else null."""
    if row is not None:
        return F.xxhash64(row)
    try:
        place = F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
        docs.select(place)
    except AnalysisException:
        return F.lit(None).cast("bigint")
    return place


def mix(docs: DataFrame, max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17, row: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies (:func:`whole_copies`) of every document (and ``row``, if one is given, as ``_row``)."""
    extra = [row.alias("_row")] if row is not None else []
    sized = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("bigint").alias("size"), F.when(F.col("doc_id").isNull(), _place(docs, row)).alias("_place"), *extra)
    sized = cut(sized, "mix-sizes")
    plan = cut(source_plan(sized, max_repeats, weights), "mix-plan")
    known = plan.withColumnRenamed("source", "_source")
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    dealt = sized.join(known, sized["source"].eqNullSafe(known["_source"])).drop("_source")
    dealt = dealt.withColumn("order", F.xxhash64("doc_id", F.lit(seed))).withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "_place", F.lit(seed)), F.col("shards")))
    per_shard = dealt.groupBy("source_no", "shard", "blocks").agg(F.sum("size").cast("double").alias("words"))
    quotas = cut(sainte_lague(per_shard, ["source_no"], "words", "blocks", "shard", "quota").select("source_no", "shard", "quota"), "mix-quotas")
    rows = dealt.select("source_no", "shard", "order", "doc_id", "source", "size", "source_size", "target", "block", *(["_row"] if extra else []))
    schema = rows.drop("source_no", "shard", "order", "block").schema.add("taken", "long").add("copies", "long")

    def choose(key: tuple, own: pd.DataFrame, quota: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["order", "doc_id", "size"], kind="stable")
        n = int(quota["quota"].iloc[0]) if len(quota) else 0
        block = int(own["block"].iloc[0]) if len(own) else 1
        sizes = own["size"].to_numpy(np.int64)
        own["taken"] = times_taken(sizes, block, n, max_repeats)
        own["copies"] = whole_copies(sizes, own["taken"].to_numpy(np.int64))
        return own[schema.names]

    return rows.groupBy("source_no", "shard").cogroup(quotas.groupBy("source_no", "shard")).applyInPandas(choose, schema)


def mixed_documents(docs: DataFrame, max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """Documents, with their own columns, each as often as the words that the mix takes of it round to."""
    docs = packed(docs, "doc_id", "source", "text")
    taken = mix(docs, max_repeats, weights, seed, row=F.col("_locator")).filter("copies > 0")
    times = cut(taken.select(F.col("_row").alias("_locator"), F.col("copies").cast("int").alias("_times")), "mix-times")
    joined = docs.join(times.hint("merge"), "_locator")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")
