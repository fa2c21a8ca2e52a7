"""The trie of conversation prefixes: which openings conversations share, and what a cache of them would save.

A conversation is the sequence of its turns' digests, 16 bytes each.
Sequences are dealt by range of (sequence, conversation) and sorted, so equal
ones lie side by side and a large group of copies is split over partitions.
Within a partition neighbours are linked by an edge as deep as their common
prefix. Union-find takes the edges in descending depth: every merge of two
components makes, or adds to, the branching node at that depth, and the path
from a component's top up to it has a node for each turn. Nodes that hold
neither the first nor the last sequence of their partition are complete. The
two paths that do, the partition's forest contracted to what can go on beyond
its boundaries, are merged across boundaries by union-find again; such rows
are as many as partitions times turns.

Defined results: a null role or text is an empty one; rows without a conv_id
belong to no conversation and are left out; turns without a number come
first, turns of one number in the order of role and text, repeated rows count
each time; other columns are ignored; an empty table has no node, not even a
root. What a task holds are the digests and lengths of its range of
conversations, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlore.plans.shared import bound_batches, cut

SIZE = 16
NOTHING = hashlib.sha256(b"").hexdigest()
#: Conversations of one range, and identifiers in one piece of text that is hashed.
RANGE, PIECE = 200_000, 1 << 16
LOCAL = (
    "spine boolean, pid int, idx int, up int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, digest binary, length bigint, left boolean, right boolean, ids array<string>, first_ids array<bigint>"
)
MERGED = "pid int, idx int, node long, own boolean, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digested(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 1), ``digest`` (hexadecimal) and ``length`` in code points of every turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = rows.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    said = F.concat(F.length("role"), F.lit(":"), "role", "text")
    return turns.select("conv_id", F.row_number().over(order).cast("bigint").alias("place"), F.md5(said).alias("digest"), F.length("text").cast("bigint").alias("length"))


def with_borrowed_heads(turns: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % every, h being crc32(c) % heads.

    The remainder has the sign of c, as in SQL. A conversation that is left
    without turns keeps one row whose ``digest`` is null.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    own = turns.filter(F.col("place") > h)
    asking = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    lent = turns.filter((F.col("conv_id") % every == 0) & (F.col("place") < heads)).select(F.col("conv_id").alias("base"), "place", "digest", "length")
    borrowed = asking.join(lent, "base").filter(F.col("place") <= F.col("h")).select("conv_id", "place", "digest", "length")
    alone = asking.select("conv_id", F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("bigint").alias("length"))
    return own.unionByName(borrowed).unionByName(alone)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``key`` (its turns' digests in order, binary) and ``lengths``. Rows whose ``digest`` is null are no turns."""
    turn: Column = F.when(F.col("digest").isNotNull(), F.struct("place", "digest", "length"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join(F.col("t.digest"), "")).alias("key"), F.col("t.length").alias("lengths"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with alike."""
    n = min(len(a), len(b)) // SIZE
    if a[: n * SIZE] == b[: n * SIZE]:
        return n
    low, high = 0, n  # the first ``low`` turns are alike, the first ``high`` are not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * SIZE] == b[: mid * SIZE] else (low, mid)
    return low


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


class Forest:
    """Nodes over one sorted range of different sequences; sums of a node leave out its own share."""

    def __init__(self, keys: list[bytes], counts: list[int], least: list[int], lengths: list[list[int]]):
        self.keys, self.lengths = keys, lengths
        self.depth, self.n, self.least = [len(k) // SIZE for k in keys], list(counts), list(least)
        size = len(keys)
        self.children, self.leaves, self.saved = [0] * size, [0] * size, [0] * size
        self.up, self.rep = [-1] * size, list(range(size))
        self._grow()

    def _new(self, depth: int, rep: int) -> int:
        for column, value in ((self.depth, depth), (self.n, 0), (self.least, None), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.up, -1), (self.rep, rep)):
            column.append(value)
        return len(self.depth) - 1

    def length(self, x: int) -> int:
        return self.lengths[self.rep[x]][self.depth[x] - 1] if self.depth[x] else 0

    def all_saved(self, x: int) -> int:
        return self.saved[x] + (self.n[x] - 1) * self.length(x)

    def all_leaves(self, x: int) -> int:
        return self.leaves[x] if self.children[x] else 1

    def _hang(self, child: int, on: int) -> None:
        self.up[child] = on
        self.children[on] += 1
        self.n[on] += self.n[child]
        self.least[on] = self.least[child] if self.least[on] is None else min(self.least[on], self.least[child])
        self.leaves[on] += self.all_leaves(child)
        self.saved[on] += self.all_saved(child)

    def _raise(self, x: int, depth: int) -> int:
        """The node at ``depth`` over ``x``, with one for each turn between."""
        while self.depth[x] > depth:
            above = self._new(self.depth[x] - 1, self.rep[x])
            self._hang(x, above)
            x = above
        return x

    def _grow(self) -> None:
        edges = sorted(((-shared_turns(self.keys[k - 1], self.keys[k]), k) for k in range(1, len(self.keys))))
        part, top = list(range(len(self.keys))), list(range(len(self.keys)))
        for less, k in edges:
            a, b = _root(part, k - 1), _root(part, k)
            on = top[a]
            if self.depth[on] > -less:
                below, on = self._raise(on, 1 - less), self._new(-less, self.rep[on])
                self._hang(below, on)
            self._hang(self._raise(top[b], 1 - less), on)
            part[b], top[a] = a, on
        if self.keys:
            self._raise(top[_root(part, 0)], 0)

    def path(self, x: int) -> list[int]:
        found = []
        while x >= 0:
            found.append(x)
            x = self.up[x]
        return found


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one sorted range: complete ones, and those on its two outer paths with what hangs on them already summed."""
    pid = TaskContext.get().partitionId()
    keys, counts, least, lengths, hashes, pieces = [], [], [], [], [], []
    for batch in batches:
        for conv, key, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not keys or keys[-1] != key:
                if len(keys) > 1:
                    pieces[-1] = None  # neither the first nor the last sequence: its hash is complete
                for column, value in ((keys, key), (counts, 0), (least, conv), (lengths, sizes), (hashes, hashlib.sha256()), (pieces, [])):
                    column.append(value)
            if counts[-1]:
                hashes[-1].update(b",")
            hashes[-1].update(str(conv).encode())
            if counts[-1] % PIECE == 0:
                pieces[-1].append([])
            pieces[-1][-1].append(conv)
            counts[-1] += 1
    if not keys:
        return
    f = Forest(keys, counts, least, lengths)
    left, right = set(f.path(0)), set(f.path(len(keys) - 1))
    spine = left | right
    inner: dict[int, list[int]] = {x: [] for x in spine}
    for x in spine:
        if f.up[x] >= 0:
            inner[f.up[x]].append(x)
    schema = pa.schema([
        ("spine", pa.bool_()), ("pid", pa.int32()), ("idx", pa.int32()), ("up", pa.int32()), *[(c, pa.int64()) for c in RESULT[:-1]], ("ends_sha256", pa.string()), ("digest", pa.binary()),
        ("length", pa.int64()), ("left", pa.bool_()), ("right", pa.bool_()), ("ids", pa.list_(pa.string())), ("first_ids", pa.list_(pa.int64())),
    ])
    rows: list[tuple] = []
    for x in range(len(f.depth)):
        up, d = f.up[x], f.depth[x]
        if x in spine:
            held = inner[x]
            whole = 0 < x < len(keys) - 1  # all its copies are in this range
            ends = pieces[x] if x in (0, len(keys) - 1) else []
            rows.append((
                True, pid, x, up, f.least[x], d, None, f.n[x], f.children[x] - len(held), f.leaves[x] - sum(map(f.all_leaves, held)), f.saved[x] - sum(map(f.all_saved, held)), hashes[x].hexdigest() if whole else None,
                keys[f.rep[x]][(d - 1) * SIZE : d * SIZE] if d else b"", f.length(x), x in left, x in right, [",".join(map(str, p)) for p in ends], [p[0] for p in ends],
            ))
        else:
            open_up = up in spine
            rows.append((
                False, pid, x, up if open_up else -1, f.least[x], d, None if open_up else f.least[up], f.n[x], f.children[x], f.all_leaves(x), f.all_saved(x),
                hashes[x].hexdigest() if x < len(keys) else NOTHING, None, None, None, None, None, None,
            ))
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outer paths of all ranges, joined where the last path of one begins like the first of the next."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["pid"], r["depth"]))
    where = {(r["pid"], r["idx"]): k for k, r in enumerate(rows)}
    part = list(range(len(rows)))
    before: list[int] = []
    paths: dict[int, tuple[list[int], list[int]]] = {}
    for k, r in enumerate(rows):
        sides = paths.setdefault(r["pid"], ([], []))
        for side, there in zip(sides, (r["left"], r["right"]), strict=True):
            if there:
                side.append(k)
    for left, right in paths.values():
        for a, b in zip(before, left, strict=False):
            if rows[a]["digest"] != rows[b]["digest"]:
                break
            part[_root(part, b)] = _root(part, a)
        before = right
    at = [_root(part, k) for k in range(len(rows))]
    least, n, children, leaves, saved = {}, {}, {}, {}, {}
    for k, r in enumerate(rows):
        x = at[k]
        least[x] = min(least.get(x, r["conv_id"]), r["conv_id"])
        for total, name in ((n, "n_convs"), (children, "n_children"), (leaves, "n_leaves"), (saved, "saved_tokens")):
            total[x] = total.get(x, 0) + r[name]
    whole = {x: r["ends_sha256"] for r, x in zip(rows, at, strict=True) if r["ends_sha256"]}
    up = {at[k]: at[where[r["pid"], r["up"]]] for k, r in enumerate(rows) if r["up"] >= 0}
    for x in sorted(n, key=lambda x: -rows[x]["depth"]):
        leaves[x] = leaves[x] if children[x] else 1
        saved[x] += (n[x] - 1) * rows[x]["length"]
        if x in up:
            children[up[x]] += 1
            leaves[up[x]] += leaves[x]
            saved[up[x]] += saved[x]
    out = [{
        "pid": r["pid"], "idx": r["idx"], "node": x, "own": x == k, "conv_id": least[x], "depth": r["depth"], "parent_conv_id": least[up[x]] if x in up else None,
        "n_convs": n[x], "n_children": children[x], "n_leaves": leaves[x], "saved_tokens": saved[x], "ends_sha256": whole.get(x),
    } for k, (r, x) in enumerate(zip(rows, at, strict=True))]
    if out:
        types = [("pid", pa.int32()), ("idx", pa.int32()), ("node", pa.int64()), ("own", pa.bool_()), *[(c, pa.int64()) for c in RESULT[:-1]], ("ends_sha256", pa.string())]
        yield pa.RecordBatch.from_pylist(out, pa.schema(types))


def _hash_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node, of its pieces in their order, which the rows come in."""
    now, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["node", "hashed"])

    for batch in batches:
        for node, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now:
                if state is not None:
                    yield out()
                now, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
    if state is not None:
        yield out()


def trie(found: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row for each node over :func:`sequences`: every different beginning of so many turns, the empty one included.

    ``ranges``: how many ranges to deal the sequences to; None: by the number of conversations.
    """
    spark = found.sparkSession
    bound_batches(spark)
    found = cut(found.select("conv_id", "key", "lengths"), "trie-sequences")
    if ranges is None:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() // RANGE + 1)
    dealt = found.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    local = cut(dealt.mapInArrow(_local, LOCAL), "trie-local")
    outer = local.filter("spine")
    merged = cut(outer.drop("ids", "first_ids").coalesce(1).mapInArrow(_merge, MERGED), "trie-merged")
    pieces = outer.select("pid", "idx", F.explode(F.arrays_zip("first_ids", "ids")).alias("x")).join(merged.select("pid", "idx", "node"), ["pid", "idx"])
    ends = pieces.select("node", F.col("x.ids").alias("piece"), F.col("x.first_ids").alias("first")).repartition("node").sortWithinPartitions("node", "first")
    ends = ends.select("node", "piece").mapInArrow(_hash_pieces, "node bigint, hashed string")
    shared = merged.filter("own").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("hashed", "ends_sha256", F.lit(NOTHING)))
    over = merged.select("pid", F.col("idx").alias("up"), F.col("conv_id").alias("over"))
    inner = local.filter("NOT spine").join(over, ["pid", "up"], "left").withColumn("parent_conv_id", F.coalesce("over", "parent_conv_id"))
    return shared.select(*RESULT).unionByName(inner.select(*RESULT))


def conversation_trie(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """The trie of conversations as they are."""
    return trie(sequences(digested(rows)), ranges)
