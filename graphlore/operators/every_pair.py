"""Every pair of vectors whose cosine reaches a threshold, none lost.

Principal directions of a sample, with the length of what they leave, turn unit
vectors into a few coordinates whose dot product is no less than the cosine. A
tree of medians over the sample cuts the coordinates' space into leaves, and
runs of leaves are cells. Pairs of cells whose boxes lie further apart than the
threshold allows are not shipped; inside a task the same holds for tiles of a
few hundred vectors, then the coordinates' product decides, then the cosine.
Each test only leaves out pairs that can't reach the threshold, so the result
is that of comparing all. The work is quadratic in the number of vectors.

Cells are bounded: one that holds too many vectors, or of which a sample says
that too many pairs will be found, is dealt by hash into several blocks. A task compares two blocks; where links are counted it gives
a row for each vector, not for each pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlore.plans.shared import cut

#: Vectors that directions and tree are made of, about, and levels of the tree.
SAMPLE, DEPTH = 32_768, 12
#: Most vectors of a block, the number of blocks that smaller tables have, most levels of cells, and most tasks.
LARGE, FEW_BLOCKS, CELL_LEVELS, MOST_TASKS = 131_072, 12, 10, 2000
#: Vectors of a tile; a tile of which one pair in this many may reach the threshold is multiplied whole; pairs of which cosines are taken at once otherwise.
TILE, DENSE, FOUND = 512, 50, 4096
#: Principal directions of the bound, and what single precision may be off in a dot product and in a squared distance.
DIRECTIONS, SLACK, FAR_SLACK = 16, 1e-5, 1e-4
#: Pairs of one batch that is handed back, about; vectors that found pairs are foretold from; most pairs foretold for a task, or the share of all.
BATCH, FORETOLD, MOST_FOUND, MOST_SHARE = 1 << 16, 8192, 1 << 22, 1 / 256


def units_of(column: pa.ListArray, size: int | None = None) -> np.ndarray:
    """Vectors that have a length as rows of length 1."""
    lengths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(lengths) != 1 or size not in (None, lengths[0]):
        raise ValueError(f"vectors of {lengths} elements, where all have one number of elements")
    m = whole(column).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def whole(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


def marked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true; several times faster than ``nonzero`` of a matrix."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def reaching(mine: np.ndarray, facing: np.ndarray, least: np.float32, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of products of at least ``least``; only rows that have one are looked through. ``room``: a buffer, as new memory takes longer than the product."""
    bound = np.matmul(mine, facing, out=room[: len(mine) * facing.shape[1]].reshape(len(mine), -1))
    rows = np.flatnonzero(bound.max(axis=1, initial=-np.inf) >= least)
    if not len(rows):
        return rows, rows
    i, j = marked(bound[rows] >= least)
    return rows[i], j


class Tree:
    """Coordinates of unit vectors and, by medians, the leaf that they fall into."""

    def __init__(self, units: np.ndarray):
        self.size = units.shape[1]
        self.main = np.linalg.eigh(units.T @ units)[1][:, -DIRECTIONS:] if self.size > DIRECTIONS + 1 else None
        at, self.axes, self.cuts = self.coordinates(units), [], []
        nodes = [np.arange(len(at))]
        for _ in range(DEPTH):
            below = []
            for rows in nodes:
                axis = int(at[rows].var(axis=0).argmax()) if len(rows) > 1 else 0
                middle = np.median(at[rows, axis]) if len(rows) else np.float32(0)
                self.axes.append(axis)
                self.cuts.append(middle)
                right = at[rows, axis] > middle
                below += [rows[~right], rows[right]]
            nodes = below
        self.axes, self.cuts = np.array(self.axes), np.array(self.cuts, dtype=np.float32)

    def coordinates(self, units: np.ndarray) -> np.ndarray:
        if self.main is None:
            return units.astype(np.float32)
        main = units @ self.main
        rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", main, main), 0))
        return np.column_stack([main, rest]).astype(np.float32)

    def leaves(self, at: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(at), dtype=np.int64), np.arange(len(at))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (at[every, self.axes[node]] > self.cuts[node])
        return node - ((1 << DEPTH) - 1)


def apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Least squared distances between points of a box and those of others."""
    gap = np.maximum(np.maximum(lows - high, low - highs), 0)
    return np.einsum("ij,ij->i", gap, gap)


class EveryPair:
    """The pairs of ``different`` (vector_id, v, n_copies), ``n`` vectors with a length, at the ``threshold`` or above; ``small``: most vectors of a block."""

    def __init__(self, different: DataFrame, n: int, threshold: float, small: int):
        self.threshold, self.small = threshold, max(small, min(LARGE, -(-n // FEW_BLOCKS)))
        self.kind = dict(different.dtypes)["vector_id"]
        picked = different.filter(F.pmod(F.xxhash64("vector_id"), F.lit(max(1, n // SAMPLE))) == 0).select("v")
        found = picked.toArrow()["v"].combine_chunks() if n else []
        if n and not len(found):
            found = different.limit(1).select("v").toArrow()["v"].combine_chunks()
        units = units_of(found) if n else np.zeros((0, 1))
        self.tree = Tree(units)
        levels = min(CELL_LEVELS, DEPTH, max(0, (-(-n // self.small) - 1).bit_length()))
        self.expected = self._foretold(units[:: max(1, len(units) // FORETOLD)], n, levels)
        self.placed = cut(different.select("vector_id", "v", "n_copies").mapInArrow(_placer(self.tree, levels), f"cell int, leaf int, vector_id {self.kind}, v {dict(different.dtypes)['v']}, n_copies bigint"), "every-placed")
        self.reach, self.tasks = self._reach()

    def _foretold(self, units: np.ndarray, n: int, levels: int) -> np.ndarray:
        """Pairs that will be found, about, by the cells of their vectors; only how work is dealt depends on it."""
        cells, single = self.tree.leaves(self.tree.coordinates(units)) >> (DEPTH - levels), units.astype(np.float32)
        met = np.zeros(1 << 2 * levels)
        for k in range(0, len(units), TILE):
            i, j = marked(single[k : k + TILE] @ single.T >= self.threshold)
            i, j = i[i + k != j] + k, j[i + k != j]
            met += np.bincount((cells[i] << levels) + cells[j], minlength=len(met))
        return met.reshape(1 << levels, -1) * (n / max(1, len(units))) ** 2 / 2

    def _reach(self) -> tuple[DataFrame, int]:
        """cell, first (its first block), parts (its blocks), others (blocks within reach); and the number of pairs of blocks."""
        boxes = self.placed.select("cell", "v").mapInArrow(_boxes(self.tree), "cell int, n bigint, low array<float>, high array<float>")
        sides = boxes.select("cell", "n", F.posexplode(F.arrays_zip("low", "high")).alias("i", "s")).groupBy("cell", "i")
        held: dict[int, dict] = {}
        for r in sides.agg(F.sum("n").alias("n"), F.min("s.low").alias("low"), F.max("s.high").alias("high")).collect():
            held.setdefault(r.cell, {})[r.i] = (r.n, r.low, r.high)
        cells = sorted(held)
        box = np.array([[held[c][i] for i in sorted(held[c])] for c in cells], dtype=np.float64).reshape(len(cells), len(held[cells[0]]) if cells else 0, 3)
        n, lows, highs = box[:, :1, 0].sum(axis=1), box[:, :, 1], box[:, :, 2]
        most = max(MOST_FOUND, self.expected.sum() * MOST_SHARE)
        parts = np.maximum(-(-n.astype(np.int64) // self.small), np.ceil(np.sqrt(self.expected.max(axis=1)[cells] / most)).astype(np.int64))
        first = np.cumsum(parts) - parts
        rows, met = [], 0
        for k, c in enumerate(cells):
            near = np.flatnonzero(apart(lows[k], highs[k], lows, highs) <= 2 - 2 * self.threshold + FAR_SLACK)
            others = [b for j in near for b in range(first[j], first[j] + parts[j])]
            met += len(others) * int(parts[k])
            rows.append((c, int(first[k]), int(parts[k]), list(map(int, others))))
        made = self.placed.sparkSession.createDataFrame(rows, "cell int, first int, parts int, others array<int>")
        return made, max(1, min(MOST_TASKS, (met + int(parts.sum())) // 2))

    def _dealt(self, every: int) -> DataFrame:
        """p, q (blocks), side, leaf and the vectors of each pair of blocks; ``every``: of each block (0), and of those within its reach the vectors asked for (1)."""
        rows = self.placed.join(F.broadcast(self.reach), "cell")
        mine = (F.col("first") + F.pmod(F.xxhash64("vector_id"), F.col("parts"))).cast("int")
        rows, kept = rows.withColumn("mine", mine), ["leaf", "vector_id", "v", "n_copies"]
        if every > 1:
            none, member = F.lit(0), rows.select(F.col("mine").alias("p"), F.col("mine").alias("q"), F.lit(0).alias("side"), *kept)
            asked = rows.filter(F.col("vector_id") % every == none).select(F.explode("others").alias("p"), *kept)
            rows = member.unionByName(asked.select("p", F.col("p").alias("q"), F.lit(1).alias("side"), *kept))
        else:
            rows = rows.select("mine", F.explode("others").alias("other"), *kept)
            rows = rows.select(F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), (F.col("mine") > F.col("other")).cast("int").alias("side"), *kept)
        return rows.repartition(self.tasks, "p", "q").sortWithinPartitions("p", "q", "side", "leaf")

    def pairs(self, every: int = 1) -> DataFrame:
        """a, b (a < b), similarity; ``every``: only pairs of which an id is divisible by it, and only those are compared."""
        return self._dealt(every).mapInArrow(_comparer(self.tree, self.threshold, every, links=False), f"a {self.kind}, b {self.kind}, similarity double")

    def counted(self) -> DataFrame:
        """vector_id, n_links, others (copies of the vectors at its links) of vectors that have a link."""
        found = self._dealt(1).mapInArrow(_comparer(self.tree, self.threshold, 1, links=True), f"vector_id {self.kind}, n_links bigint, others bigint")
        return found.groupBy("vector_id").agg(F.sum("n_links").alias("n_links"), F.sum("others").alias("others"))


def _placer(tree: Tree, levels: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = tree.leaves(tree.coordinates(units_of(b.column("v"), tree.size)))
                cell = leaf >> (DEPTH - levels)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(leaf, pa.int32()), *b.columns], ["cell", "leaf", *b.schema.names])

    return run


def _boxes(tree: Tree):
    """For each task one row a cell: its vectors and their least and greatest coordinates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            at, cells = tree.coordinates(units_of(b.column("v"), tree.size)), b.column("cell").to_numpy()
            for cell in np.unique(cells).tolist():
                here = at[cells == cell]
                n, low, high = held.get(cell, (0, here[0], here[0]))
                held[cell] = (n + len(here), np.minimum(low, here.min(axis=0)), np.maximum(high, here.max(axis=0)))
        if held:
            n, low, high = zip(*held.values(), strict=True)
            kind = pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(n, pa.int64()), pa.array(list(low), kind), pa.array(list(high), kind)], ["cell", "n", "low", "high"])

    return run


class _Side:
    """Vectors of one side of a task, in the order of their leaves."""

    def __init__(self, rows: pa.RecordBatch, tree: Tree):
        column = rows.column("v")
        self.ids, self.copies, self.values = rows.column("vector_id"), rows.column("n_copies").to_numpy(), whole(column)
        self.starts = np.arange(0, len(rows), TILE)
        self.at = [tree.coordinates(units_of(column.slice(k, TILE), tree.size)) for k in self.starts.tolist()]
        self.facing = [np.ascontiguousarray(x.T) for x in self.at]
        self.low, self.high = (np.array([f(x, axis=0) for x in self.at]) for f in (np.min, np.max))

    def tile(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of a tile in double precision, and their squared lengths."""
        m = self.values[k : k + TILE].astype(np.float64)
        return m, np.einsum("ij,ij->i", m, m)


def _met(x: _Side, y: _Side, threshold: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Starts of a tile of ``x`` and one of ``y``, places in them of pairs that reach the threshold, and cosines; one side with itself: each pair once."""
    least, far, room = np.float32(threshold - SLACK), 2 - 2 * threshold + FAR_SLACK, np.empty(TILE * TILE, dtype=np.float32)
    for k, a in enumerate(x.starts.tolist() if len(y.starts) else ()):
        from_tile = k if x is y else 0
        near = from_tile + np.flatnonzero(apart(x.low[k], x.high[k], y.low[from_tile:], y.high[from_tile:]) <= far)
        mine, own = x.at[k], None
        for b in y.starts[near].tolist():
            i, j = reaching(mine, y.facing[b // TILE], least, room)
            if not len(i):
                continue
            if x is y and a == b:
                later = j > i
                i, j = i[later], j[later]
            own = own or x.tile(a)
            (m, long), (others, lengths) = own, y.tile(b)
            if len(i) * DENSE > len(m) * len(others):
                dots = (m @ others.T)[i, j]
            else:
                dots = np.concatenate([np.einsum("ij,ij->i", m[i[s : s + FOUND]], others[j[s : s + FOUND]]) for s in range(0, max(1, len(i)), FOUND)])
            score = np.minimum(dots / np.sqrt(long[i] * lengths[j]), 1.0)
            here = score >= threshold
            if here.any():
                yield a, b, i[here], j[here], score[here]


def _linked(x: _Side, y: _Side, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of every vector of two sides, and copies at their other ends."""
    links = {id(s): np.zeros((2, len(s.ids)), dtype=np.int64) for s in (x, y)}
    for a, b, i, j, _ in _met(x, y, threshold):
        for s, at, mine, t, to, theirs in ((x, a, i, y, b, j), (y, b, j, x, a, i)):
            most = min(TILE, len(s.ids) - at)
            links[id(s)][0, at : at + most] += np.bincount(mine, minlength=most)
            links[id(s)][1, at : at + most] += np.bincount(mine, weights=t.copies[to + theirs], minlength=most).astype(np.int64)
    for s in {id(s): s for s in (x, y)}.values():
        n, others = links[id(s)]
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([s.ids.take(pa.array(some)), pa.array(n[some]), pa.array(others[some])], ["vector_id", "n_links", "others"])


def _paired(x: _Side, y: _Side, threshold: float, every: int) -> Iterator[pa.RecordBatch]:
    """Pairs of two sides; ``every``: of vectors asked for and the members of a block, where two that are both asked for meet in two ways."""
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        i, j, score = (np.concatenate(c) for c in zip(*held, strict=True))
        a, b = x.ids.take(pa.array(i)), y.ids.take(pa.array(j))
        swap = pc.greater(a, b)
        if every > 1:
            once = pc.or_(swap, pa.array(b.to_numpy() % every != 0))
            a, b, swap, score = a.filter(once), b.filter(once), swap.filter(once), score[once.to_numpy(zero_copy_only=False)]
        return pa.RecordBatch.from_arrays([pc.if_else(swap, b, a), pc.if_else(swap, a, b), pa.array(score)], ["a", "b", "similarity"])

    for a, b, i, j, score in _met(x, y, threshold):
        held.append((a + i, b + j, score))
        if (n := n + len(i)) >= BATCH:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def _comparer(tree: Tree, threshold: float, every: int, links: bool):
    """For rows sorted by pair of blocks, side and leaf: pairs, or links of each vector."""

    def found(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(group).combine_chunks().to_batches()[0]
        group.clear()
        turn = int(np.searchsorted(rows.column("side").to_numpy(), 1))
        x = _Side(rows.slice(0, turn), tree)
        y = x if rows.column("p")[0] == rows.column("q")[0] and every == 1 else _Side(rows.slice(turn), tree)
        if every > 1:
            x, y = y, x
        yield from _linked(x, y, threshold) if links else _paired(x, y, threshold, every)

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            where = np.stack([b.column(c).to_numpy() for c in ("p", "q")], axis=1)
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
