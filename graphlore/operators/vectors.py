"""Exact vector search and quantisation on arrays, inside the JVM; vectors of hashed words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlore.functions.columns import let
from graphlore.plans.shared import bound_batches


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, lengths: Column | None = None) -> Column:
    """Cosine in double precision; 0 where a vector has no length. ``lengths``: the product of both lengths, where it is known."""
    norm = length(a) * length(b) if lengths is None else lengths
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(norm != 0, norm))


def clamp(score: Column) -> Column:
    """A score between 0 and 1; 0.5 where it is no number."""
    return F.when(score.isNull() | F.isnan(score), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def knn(rows: DataFrame, query: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of a one-row ``query`` (column ``q``), with ``similarity`` and ``rank`` from 1.

    The query is one row, so its broadcast is constant; the cut is a
    distributed top-k and vectors are dropped before it.
    """
    if not isinstance(k, int) or k < 1:
        raise ValueError("k is a whole number from 1 on")
    own = [c for c in rows.columns if c != vector]
    scored = rows.join(F.broadcast(query.select(doubles(F.col("q")).alias("_q")).limit(1)))
    scored = scored.select(*own, cosine(doubles(F.col(vector)), F.col("_q")).alias("similarity"))
    top = scored.orderBy(F.desc("similarity"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")).cast("bigint"))


def vector_of(rows: DataFrame, row_id: int, vector: str = "embedding") -> DataFrame:
    return rows.filter(F.col("id") == row_id).select(F.col(vector).alias("q")).limit(1)


def vector_retrieve(rows: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """id, score, rank: nearest by cosine, scores clamped."""
    return knn(rows.select("id", "embedding"), query, k).select("id", clamp(F.col("similarity")).alias("score"), "rank")


def centroids(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group. Sums are taken by position, so partial sums, not vectors, are shuffled."""
    parts = rows.select(by, F.posexplode(doubles(F.col(vector))).alias("i", "x"))
    means = parts.groupBy(by, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select(by, F.transform("p", lambda s: s["x"]).alias("q"))


#: Query vectors that are sent to every executor at once; :func:`knn_blocks` takes more.
MOST_QUERIES = 10_000


def knn_batch(rows: DataFrame, queries: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """query, id, similarity, rank of the ``k`` nearest rows of every query (columns ``query``, ``q``).

    Rows stay where they are; the rank's limit is applied inside each
    partition first, so only ``k`` candidates a query and partition are
    shuffled.
    """
    n = queries.limit(MOST_QUERIES + 1).count()
    if n > MOST_QUERIES:
        raise ValueError("too many query vectors for one pass; use knn_blocks")
    # lengths are taken once for each vector, not for each pair
    own = rows.select("id", doubles(F.col(vector)).alias("_v")).withColumn("_vl", length(F.col("_v")))
    asked = queries.select("query", doubles(F.col("q")).alias("_q")).withColumn("_ql", length(F.col("_q")))
    pairs = own.join(F.broadcast(asked))
    scored = pairs.select("query", "id", cosine(F.col("_v"), F.col("_q"), F.col("_vl") * F.col("_ql")).alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def knn_blocks(rows: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", block: int = MOST_QUERIES) -> DataFrame:
    """:func:`knn_batch` for any number of queries: dealt by hash into blocks of about half of what one pass takes, a pass over the rows for each."""
    n = max(1, -(-2 * queries.count() // block))
    dealt = [queries.filter(F.pmod(F.xxhash64("query"), F.lit(n)) == j) for j in range(n)]
    return reduce(DataFrame.unionByName, [knn_batch(rows, part, k, vector) for part in dealt])


def hashed_words(texts: DataFrame, size: int = 64) -> DataFrame:
    """id, embedding of texts (id, text): each word counts up or down, by its digest, at the place its digest gives.

    A task counts the words of whole texts, so a row moves ``size`` numbers,
    whatever the length of its text. Texts of one id are taken
    together; one without words has no row. ``size``: 256 at most.
    """
    if not 1 <= size <= 256:
        raise ValueError("size is a whole number from 1 to 256")
    bound_batches(texts.sparkSession)
    counted = texts.select("id", F.col("text").cast("binary").alias("t")).mapInArrow(_word_counts(size), f"id {dict(texts.dtypes)['id']}, c array<int>")
    sums = counted.groupBy("id").agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(size)])
    return sums.select("id", F.array(*[F.col(f"c{i}").cast("float") for i in range(size)]).alias("embedding"))


#: Bytes of a text that are split at once, words whose digests a task remembers (the first it meets, so the frequent ones), and their most bytes.
PIECE, KNOWN, LONGEST = 1 << 20, 1 << 18, 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _Places(dict):
    """Of a word twice the place its digest gives, and one more if it counts down."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        digest = hashlib.md5(word, usedforsecurity=False).digest()
        place = digest[0] % self.size * 2 + digest[1] % 2
        if len(word) <= LONGEST and len(self) < KNOWN:
            self[word] = place
        return place


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at white space, so that not all its words are held at once."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _word_counts(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _Places(size).__getitem__
        for b in batches:
            kept, counts = [], []
            for k, text in enumerate(b.column(1)):
                found = np.zeros(2 * size, dtype=np.int64)
                for piece in _pieces(text.as_py() or b""):
                    words = piece.split()  # bytes are split at ASCII white space, as words_of does
                    found += np.bincount(np.fromiter(map(place, words), np.int16, len(words)), minlength=2 * size)
                if found.any():
                    kept.append(k)
                    counts.append(found[::2] - found[1::2])
            if kept:
                values = pa.array(np.concatenate(counts), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * size, pa.int32()), values)], ["id", "c"])

    return run


def quantize(v: Column) -> Column:
    """struct(scale, codes): int8 codes of a vector by its greatest absolute value."""
    top = F.array_max(F.transform(doubles(v), F.abs))
    scale = F.when(top > 0, top / 127.0).otherwise(F.lit(0.0))
    code = lambda s: F.transform(doubles(v), lambda x: F.when(s == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x / F.when(s != 0, s) + 0.5)))).cast("tinyint"))
    return let(scale, lambda s: F.struct(s.alias("scale"), code(s).alias("codes")))


def dequantize(q: Column, size: int | None = None) -> Column:
    """The vector, in single precision, of a scale and its codes. ``size``: if given, codes of another length are an error, as is a scale that is no finite number from 0 on."""
    made = F.transform(q["codes"], lambda c: (c.cast("double") * q["scale"]).cast("float"))
    if size is None:
        return made
    sound = (F.size(q["codes"]) == size) & (q["scale"] >= 0) & (q["scale"] < float("inf"))
    return F.when(F.coalesce(sound, F.lit(False)), made).otherwise(F.raise_error(F.lit(f"codes are not {size} numbers with a finite scale")))


def healthy(v: Column, size: int) -> Column:
    """Whether a vector has ``size`` finite elements."""
    return v.isNotNull() & (F.size(v) == size) & F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
