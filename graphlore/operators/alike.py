"""All pairs of vectors whose cosine reaches a threshold, by buckets of random projections.

Unit vectors of at least the threshold's cosine lie within a known distance.
A projection on a random direction, cut into slots of a width that is a
multiple of that distance, puts two such vectors into one slot with a known
least probability, whatever the other vectors look like; a run joins a number of
projections into one bucket, and runs are repeated until the target recall is
met. Where no pair may be lost, ``exact`` makes one bucket of all, whose pairs
are those of :class:`EveryPair`. How wide slots are, how many projections a run
joins and so how many runs there are is chosen by what they cost on a sample:
rows shipped and pairs compared. Small tables come out as one bucket, which is exact.

Pairs are compared exactly inside buckets, large ones in blocks, and each is
given by the first run in which it meets, so no pair is written twice. A cosine
is the dot product over the root of the product of both squared lengths, in
double precision, so that one exactly at the threshold is no matter of rounding.

Defined results: equal vectors are one vector, named by its least id; rows
without an id, with a vector that is null, has no length or holds what is no
finite number are like nothing and left out; an empty table gives no
pairs; other columns are ignored. All vectors have one number of elements, else an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlore.operators.every_pair import DIRECTIONS, FOUND, SLACK, TILE, EveryPair, marked, reaching, units_of, whole
from graphlore.operators.vectors import MOST_QUERIES, doubles, length
from graphlore.plans.shared import bound_batches, cut

#: Probability with which a pair exactly at the threshold is found; pairs above it are found more surely.
TARGET_RECALL = 0.999
#: Vectors that the choice of slots and runs is measured on.
SAMPLE = 65_536
#: Slot widths that are tried, in multiples of the threshold's distance; most projections in one run, in all runs, and most runs.
WIDTHS, DEEPEST, MOST_PROJECTIONS, MOST_RUNS = (2, 3, 4, 6, 8), 48, 4096, 256
#: Comparisons that shipping a row to one bucket is worth.
ROW_COST = 32
#: Most vectors of a bucket, or of a block of one, that a task compares with each other.
SMALL = 4096
#: Pairs that are compared at once.
STRIP = 1 << 22


def meeting(width: float) -> float:
    """Least probability that two vectors within the threshold's distance fall into one slot of ``width`` times that distance."""
    outside = 0.5 * math.erfc(width / math.sqrt(2))
    return 1 - 2 * outside - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


class Slots:
    """Random projections of ``size`` elements in ``runs`` runs of ``depth``, made again in every task from the seed."""

    def __init__(self, size: int, distance: float, width: float, depth: int, runs: int, seed: int = 0):
        self.size, self.distance, self.width, self.depth, self.runs, self.seed = size, distance, width, depth, runs, seed

    def _made(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.standard_normal((self.size, self.runs * self.depth)), rng.random(self.runs * self.depth)

    def slots(self, units: np.ndarray) -> np.ndarray:
        """Slot of each vector in every projection (vectors by runs by depth)."""
        directions, shift = self._made()
        found = np.floor(units @ directions / (self.width * self.distance) + shift).astype(np.int64)
        return found.reshape(len(units), self.runs, self.depth)

    def keys(self, units: np.ndarray) -> np.ndarray:
        """One 64-bit bucket for each vector and run."""
        mixed = (self.slots(units).view(np.uint64) * _multipliers(self.depth)).sum(axis=2, dtype=np.uint64)
        return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + _multipliers(self.runs)


def choose(sample: np.ndarray, n: int, threshold: float, target: float = TARGET_RECALL) -> Slots:
    """The cheapest slots that keep the target recall for ``n`` vectors like those of ``sample`` (unit length)."""
    size = sample.shape[1] if len(sample) else 1
    distance = max(math.sqrt(2 - 2 * threshold), 1e-6)
    best, least = Slots(size, distance, 1, 0, 1), ROW_COST + n / 2
    every = len(sample) * (len(sample) - 1) / 2
    for width in WIDTHS if every else ():
        slots = Slots(size, distance, width, DEEPEST, 1, seed=1).slots(sample)[:, 0, :].view(np.uint64)
        keys = np.zeros(len(sample), dtype=np.uint64)
        for depth, by in enumerate(_multipliers(DEEPEST), start=1):
            keys = keys + slots[:, depth - 1] * by
            runs = math.ceil(math.log(1 - target) / math.log(1 - meeting(width) ** depth))
            if runs > MOST_RUNS or runs * depth > MOST_PROJECTIONS or runs * ROW_COST > least:
                break
            times = np.unique(keys, return_counts=True)[1].astype(np.float64)
            cost = runs * (ROW_COST + n / 2 * (times * (times - 1)).sum() / 2 / every)
            if cost < least:
                best, least = Slots(size, distance, width, depth, runs), cost
    return best


class Alike:
    """The pairs of ``rows`` (id, embedding) at the ``threshold`` (above 0, below 1) or above.

    ``members``: id, vector_id (least id with an equal vector), n_copies. ``n``: different vectors. ``slots``: what was chosen.
    """

    def __init__(self, rows: DataFrame, threshold: float, target: float = TARGET_RECALL, small: int = SMALL, slots: Slots | None = None, exact: bool = False):
        if not 0 < threshold < 1 or not 0 < target < 1:
            raise ValueError("threshold and target are between 0 and 1")
        bound_batches(rows.sparkSession, rows=2000)
        self.threshold, self.small = threshold, small
        rows = rows.select("id", F.col("embedding").alias("v")).filter(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (length(doubles(F.col("v"))) > 0))
        different = cut(rows.groupBy("v").agg(F.min("id").alias("vector_id"), F.count(F.lit(1)).alias("n_copies")), "alike-vectors")
        # by a digest first, as sorting arrays takes most of such a join
        digest = F.xxhash64("v").alias("digest")
        self.members = rows.select("*", digest).join(different.select("*", digest).hint("merge"), ["digest", "v"]).select("id", "vector_id", "n_copies")
        self.copies = different.select("vector_id", "n_copies")
        self.n = different.count()
        self.every = EveryPair(different, self.n, threshold, small) if exact else None
        if exact:
            slots = Slots(1, 1, 1, 0, 1)
        if slots is None:
            picked = different.orderBy(F.xxhash64("vector_id"), "vector_id").limit(SAMPLE).select("v").toArrow()["v"]
            slots = choose(units_of(picked.combine_chunks()) if self.n else np.zeros((0, 1)), self.n, threshold, target)
        self.slots = slots
        if exact:
            self._sizes = rows.sparkSession.range(1).select(F.lit(self.n).cast("bigint").alias("size"))
            return
        self._keyed = cut(_keyed(different.select("vector_id", "v"), slots), "alike-keys")
        met = self._keyed.select("vector_id", F.posexplode("keys").alias("run", "key"))
        self._sizes = cut(met.groupBy("run", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "alike-sizes")

    def compared(self) -> DataFrame:
        """n_vectors, n_runs, n_compared (pairs that share a bucket, in all runs; ``exact``: every pair, though most are decided by boxes or coordinates), n_all (pairs there are)."""
        pairs = F.coalesce(F.sum(F.expr("size * (size - 1) div 2")), F.lit(0))
        return self._sizes.agg(F.lit(self.n).cast("bigint").alias("n_vectors"), F.lit(self.slots.runs).cast("bigint").alias("n_runs"), pairs.alias("n_compared"), F.lit(self.n * (self.n - 1) // 2).cast("bigint").alias("n_all"))

    def pairs(self, every: int = 1) -> DataFrame:
        """a, b (ids of different vectors, a < b), similarity; ``every``: only pairs of which an id is divisible by it, left out before they leave the tasks, or, where all pairs are, before they are compared."""
        if self.every:
            return self.every.pairs(every)
        met = self._keyed.select("vector_id", F.posexplode("keys").alias("run", "key"))
        blocks = F.ceil(F.col("size") / self.small).cast("int")
        held = met.join(self._sizes.hint("merge"), ["run", "key"]).groupBy("vector_id").agg(F.collect_list(F.struct("run", "key", blocks.alias("blocks"))).alias("held"))  # one a run at most
        rows = self._keyed.join(held.hint("merge"), "vector_id").select("vector_id", "v", F.explode("held").alias("h"))
        # a bucket of several blocks sends each vector to the tasks of its block with every block
        mine = F.pmod(F.xxhash64("vector_id"), F.col("h.blocks")).cast("int")
        rows = rows.select("vector_id", "v", "h.run", "h.key", mine.alias("side"), F.explode(F.sequence(F.lit(0), F.col("h.blocks") - 1)).alias("other"))
        rows = rows.select("run", "key", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "vector_id", "v")
        dealt = rows.repartition("run", "key", "p", "q").sortWithinPartitions("run", "key", "p", "q")
        return dealt.mapInArrow(_comparer(self.threshold, self.slots, every), f"a {dict(rows.dtypes)['vector_id']}, b {dict(rows.dtypes)['vector_id']}, similarity double")

    def links(self) -> DataFrame:
        """id, vector_id, n_copies, n_links (different vectors at the threshold), n_row_links (other rows at the threshold, copies included) of every row that has a vector."""
        if self.every:
            counted = self.every.counted()
        else:
            found = self.pairs().select("a", "b")
            ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
            counted = ends.join(self.copies.select(F.col("vector_id").alias("b"), "n_copies").hint("merge"), "b")
            counted = counted.groupBy(F.col("a").alias("vector_id")).agg(F.count(F.lit(1)).alias("n_links"), F.sum("n_copies").alias("others"))
        all_rows = self.members.join(counted.hint("merge"), "vector_id", "left")
        none = F.lit(0).cast("bigint")
        return all_rows.select("id", "vector_id", "n_copies", F.coalesce("n_links", none).alias("n_links"), (F.coalesce("others", none) + F.col("n_copies") - 1).alias("n_row_links"))


def within(rows: DataFrame, queries: DataFrame, threshold: float, block: int = MOST_QUERIES) -> DataFrame:
    """query, id, similarity of all ``rows`` (id, embedding) at the ``threshold`` or above of stated queries (query, q), exactly.

    Queries are sent to every task in blocks of about half of ``block``, a
    pass over the rows for each; rows stay where they are.
    """
    rows, queries = rows.filter(F.col("embedding").isNotNull()), queries.filter(F.col("q").isNotNull())
    n = max(1, -(-2 * queries.count() // block))
    kinds = f"query {dict(queries.dtypes)['query']}, id {dict(rows.dtypes)['id']}, similarity double"
    out = None
    for k in range(n):
        asked = queries.filter(F.pmod(F.xxhash64("query"), F.lit(n)) == k).select("query", doubles(F.col("q")).alias("q")).toArrow()
        if asked.num_rows:
            held = rows.sparkSession.sparkContext.broadcast((asked["query"].combine_chunks(), _padded(asked["q"].combine_chunks())))
            found = rows.select("id", "embedding").mapInArrow(_near(held, threshold), kinds)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], kinds)


def _near(held, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = held.value
        # every product is taken whole, in single precision, and what may reach the threshold again in double precision
        least, room = np.float32(threshold - max(SLACK, asked.shape[1] * 2.0**-23)), np.empty(TILE * TILE, dtype=np.float32)
        facing = [(at, np.ascontiguousarray(_single(asked[at : at + TILE]).T)) for at in range(0, len(asked), TILE)]
        for b in batches:
            for at in range(0, b.num_rows, TILE):
                some = b.slice(at, TILE)
                vectors, met = _padded(some.column(1)), []
                single = _single(vectors)
                for to, tile in facing:
                    i, j = reaching(single, tile, least, room)
                    if len(i):
                        met += [(x, to + y, score) for x, y, score in _reached(vectors, asked[to : to + TILE], i, j, threshold)]
                if met:
                    i, j, score = (np.concatenate(c) for c in zip(*met, strict=True))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), some.column(0).take(pa.array(i)), pa.array(score)], ["query", "id", "similarity"])

    return run


def _single(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision; those without a finite length are zeros."""
    long = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, long, out=np.zeros_like(vectors), where=(long > 0) & np.isfinite(long)).astype(np.float32)


def _padded(column: pa.Array) -> np.ndarray:
    """Vectors as they are, in double precision, null ones as zeros."""
    if not column.null_count and not column.values.null_count and len(pc.unique(pc.list_value_length(column))) == 1:
        return whole(column).astype(np.float64)
    found = column.to_pylist()
    size = max((len(v) for v in found if v is not None), default=0)
    return np.array([v if v is not None else [0.0] * size for v in found], dtype=np.float64).reshape(len(found), size)


def _reached(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows ``i`` of ``a`` and ``j`` of ``b`` those whose cosine reaches the threshold, with it, some at a time."""
    long, others = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    for at in range(0, len(i), FOUND):
        x, y = i[at : at + FOUND], j[at : at + FOUND]
        score = np.minimum(np.einsum("ij,ij->i", a[x], b[y]) / np.sqrt(long[x] * others[y]), 1.0)
        here = score >= threshold
        if here.any():
            yield x[here], y[here], score[here]


def _bound(units: np.ndarray) -> np.ndarray:
    """Vectors whose dot products are no less than those of ``units``: by its principal directions, with the length of the rest."""
    if units.shape[1] <= DIRECTIONS + 1:
        return units.astype(np.float32)
    some = units[:: max(1, len(units) // 10_000)]
    main = units @ np.linalg.eigh(some.T @ some)[1][:, -DIRECTIONS:]
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", main, main), 0))
    return np.column_stack([main, rest]).astype(np.float32)


def _keyed(vectors: DataFrame, slots: Slots) -> DataFrame:
    """vector_id, v, keys: the bucket of each run."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = slots.keys(units_of(b.column(1), slots.size)).view(np.int64)
                ends = pa.array(np.arange(len(keys) + 1) * slots.runs, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))], ["vector_id", "v", "keys"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(run, f"vector_id {kinds['vector_id']}, v {kinds['v']}, keys array<bigint>")


def _comparer(threshold: float, slots: Slots, every: int = 1):
    """For rows sorted by bucket and block: the pairs of each that reach the threshold and have met in no earlier run."""

    def found(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
        run, p, q = (held.column(c)[0].as_py() for c in ("run", "p", "q"))
        units, side, keys = units_of(held.column("v")), held.column("side").to_numpy(), None
        rows, others = np.flatnonzero(side == p), np.flatnonzero(side == q)
        vectors, bound, ids = whole(held.column("v")).astype(np.float64), _bound(units), held.column("vector_id")
        asked = ids.to_numpy() % every == 0 if every > 1 else None
        facing = np.ascontiguousarray(bound[others].T)
        for at in range(0, len(rows) if len(others) else 0, step := max(1, STRIP // max(1, len(others)))):
            some = rows[at : at + step]
            i, j = marked(bound[some] @ facing >= np.float32(threshold - SLACK))
            if p == q:
                later = j > i + at
                i, j = i[later], j[later]
            i, j = some[i], others[j]
            if asked is not None:
                here = asked[i] | asked[j]
                i, j = i[here], j[here]
            if keys is None and run and len(i):
                keys = slots.keys(units)  # made again here rather than shipped with every row
            for before in range(run if len(i) else 0):
                first = keys[i, before] != keys[j, before]
                i, j = i[first], j[first]
            for x, y, score in _reached(vectors, vectors, i, j, threshold):
                a, b = ids.take(pa.array(x)), ids.take(pa.array(y))
                swap = pc.greater(a, b)
                yield pa.RecordBatch.from_arrays([pc.if_else(swap, b, a), pc.if_else(swap, a, b), pa.array(score)], ["a", "b", "similarity"])

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            where = np.stack([b.column(c).to_numpy() for c in ("run", "key", "p", "q")], axis=1)
            starts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for s, e in zip(starts, starts[1:], strict=False):
                here = tuple(where[s].tolist())
                if here != last and group:
                    yield from found(group)
                    group = []
                last = here
                group.append(b.slice(s, e - s))
        if group:
            yield from found(group)

    return solve
