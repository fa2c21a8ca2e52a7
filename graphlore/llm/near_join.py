"""Jaccard join of word shingles by chosen paths, and the classes of near copies.

A text is the set of its shingles of five words. In each run a set chooses
tokens by a shared hash, on average 1 / threshold of them, and goes to their
buckets; two sets of at least the threshold's similarity then share a bucket
with probability 1 - 1/e or more, and runs are repeated until the target
recall is met. Small buckets are compared by brute force. A large bucket
whose sets are unlike each other is split again by tokens chosen anew along
its path, as often as keeps the target recall at every depth; one whose sets
are alike, which no token splits, is compared in blocks. Every pair is counted in the least of the buckets that hold both, so
no pairs are written: a bucket gives each of its sets a number of links and
one link of a spanning forest. Equal sets are one set throughout.

Defined results: words are parted by ASCII white space; texts of one to four
words have one shingle, all their words; texts without words are like no
other, each a class of its own; null texts count as empty; repeated rows are
one class; an empty table gives an empty result; other columns are ignored
or, by :func:`one_of_each`, passed on. Shingles are compared by 32-bit
hashes, so a similarity is off by one shingle for about one pair in 10^4.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlore.functions.columns import words_of
from graphlore.plans.shared import bound_batches, cut, located, packed

SHINGLE = 5
#: Similarity from which two sets are linked, as a fraction of whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
TARGET_RECALL = 0.993
#: Most sets and most tokens of a bucket, or of a block of one, that a task compares: some tens of MB, some seconds.
SMALL, TOKENS = 16_384, 8_000_000
#: Sets of a large bucket are alike, and it isn't split, from this mean similarity on at the latest.
ALIKE = 0.25
#: Most times that a bucket is split again; what is still large then is compared in blocks.
DEPTH = 3
SKETCH = 4


def recall(n_runs: int, repeats: int) -> float:
    """Least probability that a pair at the threshold is compared, when all buckets it shares are split ``DEPTH`` times."""
    kept = 1.0
    for n in [repeats] * DEPTH + [n_runs]:
        kept = 1 - math.exp(-n * kept)
    return kept


def runs(target: float = TARGET_RECALL) -> tuple[int, int]:
    """Runs, and choices in each split of a bucket, after which a pair at the threshold has been compared with the target's probability."""
    n = math.ceil(-math.log(1 - target))
    while True:
        for repeats in range(1, 2 * n + 1):
            if recall(n, repeats) >= target:
                return n, repeats
        n += 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a fixed invertible scramble)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _seed(k: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(b"path %d" % k, digest_size=8).digest(), "little"))


def shingle_sets(flat: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; ``flat``: word hashes of texts end to end."""
    flat = flat.view(np.uint64)
    n = len(flat) - SHINGLE + 1
    every = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(SHINGLE):
        every = mix(every + flat[k : k + len(every)] + np.uint64(k + 1))
    out, at = [], 0
    for e in ends.tolist():
        if e - at >= SHINGLE:
            out.append(np.unique(every[at : e - SHINGLE + 1]))
        elif e > at:
            one = np.zeros(1, dtype=np.uint64)
            for k in range(at, e):
                one = mix(one + flat[k] + np.uint64(1 << 40))
            out.append(one)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at = e
    return out


def tokens_of(own: np.ndarray) -> np.ndarray:
    """32-bit tokens of a set, ascending."""
    t = (own >> np.uint64(32)).astype(np.uint32)
    return t if len(t) < 2 or (t[1:] != t[:-1]).all() else np.unique(t)


def chosen(tokens: np.ndarray, path: np.uint64) -> np.ndarray:
    """Keys of the tokens that a set chooses at a place of its path."""
    keys = mix(tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ path)
    share = DENOMINATOR / (NUMERATOR * max(len(tokens), 1))
    return keys if share >= 1 else keys[keys < np.uint64(int(share * 2**64))]


def _words(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("words")
    lengths = np.array([n or 0 for n in column.value_lengths().to_pylist()], dtype=np.int64)
    return shingle_sets(np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)), np.cumsum(lengths))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("words", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))


def _described(docs: DataFrame, n_runs: int) -> DataFrame:
    """f, r, doc_id, g (digest of the set, null if empty), n (tokens), keys (buckets of all runs) and sketch of each text."""
    seeds, sketches = [_seed(k) for k in range(n_runs)], [_seed(1000 + k) for k in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, n, keys, sketch = [], [], [], []
            for own in _words(batch):
                n.append(len(own))
                if not len(own):
                    g.append(None), keys.append([]), sketch.append([])
                    continue
                t = tokens_of(own)
                g.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                keys.append(np.unique(np.concatenate([chosen(t, s) for s in seeds])).view(np.int64))
                wide = t.astype(np.uint64)
                sketch.append(np.array([mix(wide ^ s).min() for s in sketches], dtype=np.uint64).view(np.int64))
            made = [pa.array(g, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("f", "r", "doc_id")), *made], names=["f", "r", "doc_id", "g", "n", "keys", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _hashed(docs).select("f", "r", "doc_id", "words").mapInArrow(run, f"f bigint, r bigint, doc_id {kind}, g binary, n bigint, keys array<bigint>, sketch array<bigint>")


def _sizes(pairs: DataFrame) -> DataFrame:
    """key, size and tokens of each bucket of ``pairs`` (g, n, key)."""
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"))


def _sorted_buckets(pairs: DataFrame, sketches: DataFrame, small: int, tokens: int, repeats: int) -> tuple[DataFrame, DataFrame]:
    """(key, g, size, tokens) of buckets to compare, and (key, g) of those to split. ``pairs``: g, n, key."""
    sizes = cut(_sizes(pairs).filter("size > 1"), "near-sizes")
    pairs = pairs.select("g", "key")
    fits = (F.col("size") <= small) & (F.col("tokens") <= tokens)
    ready = pairs.join(sizes.filter(fits).hint("merge"), "key")
    large = sizes.filter(~fits)
    if large.isEmpty():
        return ready, ready.limit(0).select("key", "g")
    rows = cut(pairs.join(large.hint("merge"), "key"), "near-large")
    # mean similarity of a bucket: how often two of its sets have one value of a sketch
    values = rows.join(sketches.hint("merge"), "g").select("key", "size", F.posexplode("sketch"))
    equal = values.groupBy("key", "size", "pos", "col").agg(F.count(F.lit(1)).cast("double").alias("n"))
    alike = equal.groupBy("key", "size").agg((F.sum(F.col("n") * F.col("n")) / (SKETCH * F.col("size").cast("double") * F.col("size"))).alias("mean"))
    # a split sends each set to so many smaller buckets that from some mean on it compares more pairs than the blocks
    least = min(ALIKE, NUMERATOR / (DENOMINATOR * repeats))
    alike = cut(alike.select("key", (F.col("mean") >= least).alias("alike")), "near-alike")
    judged = rows.join(alike.hint("merge"), "key")
    return ready.unionByName(judged.filter("alike").drop("alike")), judged.filter("not alike").select("key", "g")


def _split(docs: DataFrame, wide: DataFrame, members: DataFrame, repeats: int) -> DataFrame:
    """g, key of the buckets that the sets of buckets ``wide`` (key, g) go to along their paths, in ``repeats`` choices of each."""
    seeds = [_seed(2000 + k) for k in range(repeats)]
    asked = wide.groupBy("g").agg(F.collect_list("key").alias("paths")).join(members.hint("merge"), "g").select("f", "r", "g", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, keys = [], []
            for own, one, paths in zip(_words(batch), batch.column("g").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                t = tokens_of(own)
                for path in np.array(paths, dtype=np.int64).view(np.uint64):
                    for s in seeds:
                        found = chosen(t, mix(np.array([path ^ s]))[0])
                        g += [one] * len(found)
                        keys += found.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.binary()), pa.array(keys, pa.int64())], names=["g", "key"])

    texts = docs.join(asked.hint("merge"), ["f", "r"])
    return _hashed(texts).select("g", "paths", "words").mapInArrow(run, "g binary, key bigint").distinct()


class _Shared:
    """How many values one row of a bucket shares with others.

    Values that many rows have are bits of a row; those that few rows have
    are lists of rows. Either way memory follows the number of values held.
    """

    def __init__(self, columns: list[np.ndarray]):
        m, few = len(columns), max(2, len(columns) // 64)
        flat = np.concatenate(columns) if columns else np.zeros(0)
        values, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), [len(c) for c in columns])
        common = times >= few
        place = np.cumsum(common) - 1
        own = common[at]
        self.bits = np.zeros((m, max(1, -(-int(common.sum()) // 64))), dtype=np.uint64)
        bit = place[at[own]]
        np.bitwise_or.at(self.bits, (row[own], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        rare = ~own & (times[at] >= 2)
        by_value = np.argsort(at[rare], kind="stable")
        self.holders = row[rare][by_value]
        self.ends = np.concatenate(([0], np.cumsum(np.where(common | (times < 2), 0, times))))
        self.values, self.starts = at[rare], np.searchsorted(row[rare], np.arange(m + 1))

    def with_next(self, i: int, end: int) -> np.ndarray:
        """For rows i + 1 to end - 1 the number of values that they share with row i."""
        both = np.bitwise_count(self.bits[i + 1 : end] & self.bits[i]).sum(axis=1, dtype=np.int64)
        mine = self.values[self.starts[i] : self.starts[i + 1]]
        if len(mine):
            rows = np.concatenate([self.holders[self.ends[v] : self.ends[v + 1]] for v in mine.tolist()])
            rows = rows[(rows > i) & (rows < end)]
            if len(rows):
                both += np.bincount(rows - i - 1, minlength=len(both))
        return both


def compare(key: int, sets: list[np.ndarray], keys: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each set of a bucket, documents that these lead to, and for each set the least one of its part of the spanning forest.

    Pairs that another, lesser bucket holds too are left to it. ``copies``:
    documents of each set. ``side``: if given, only pairs of different sides
    are compared.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    links, others, label = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64), np.arange(m)
    order = np.argsort(size, kind="stable")
    shared = _Shared([sets[k] for k in order])
    lesser = _Shared([keys[k][keys[k] < key] for k in order])
    sized, sides = size[order], side[order] if side is not None else None
    for i in range(m - 1):
        # sets are in the order of their sizes: those that are too large for this one end the search
        end = int(np.searchsorted(sized, sized[i] * DENOMINATOR // NUMERATOR, side="right"))
        if end <= i + 1:
            continue
        linked = (NUMERATOR + DENOMINATOR) * shared.with_next(i, end) >= NUMERATOR * (sized[i + 1 : end] + sized[i])
        if sides is not None:
            linked &= sides[i + 1 : end] != sides[i]
        if not linked.any():
            continue
        linked &= lesser.with_next(i, end) == 0
        j = np.flatnonzero(linked) + i + 1
        if len(j):
            links[order[i]] += len(j)
            links[order[j]] += 1
            others[order[i]] += copies[order[j]].sum()
            others[order[j]] += copies[order[i]]
            parts = np.unique(label[order[np.append(j, i)]])
            if len(parts) > 1:
                label[np.isin(label, parts)] = parts[0]
    return links, others, label


def _linked(docs: DataFrame, buckets: DataFrame, members: DataFrame, small: int, tokens: int) -> DataFrame:
    """g, root, links, others from the comparison of buckets (key, g, size, tokens); root: a set of the same part; others: documents of linked sets."""
    blocks = F.greatest(F.ceil(F.col("size") / small), F.ceil(F.col("tokens") / tokens)).cast("int")
    one = F.struct("key", blocks.alias("blocks"))
    asked = buckets.groupBy("g").agg(F.collect_list(one).alias("held")).join(members.hint("merge"), "g").select("f", "r", "g", "n_copies", "held")
    asked = asked.withColumn("own", F.pmod(F.xxhash64("g"), F.lit(1 << 30)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [tokens_of(x).view(np.int32) for x in _words(batch)]
            row, key, p, q, side, keys = [], [], [], [], [], []
            for k, (held, own) in enumerate(zip(batch.column("held").to_pylist(), batch.column("own").to_pylist(), strict=True)):
                every = [h["key"] for h in held]
                for h in held:
                    mine = own % h["blocks"]
                    for other in range(h["blocks"]):
                        row.append(k), key.append(h["key"]), p.append(min(mine, other)), q.append(max(mine, other)), side.append(mine), keys.append(every)
            names = ["key", "p", "q", "side", "g", "copies", "keys", "tokens"]
            for s in range(0, len(row), 500):
                e = s + 500
                made = [pa.array(key[s:e], pa.int64()), *(pa.array(x[s:e], pa.int32()) for x in (p, q, side)), *(batch.column(x).take(pa.array(row[s:e], pa.int64())) for x in ("g", "n_copies")), pa.array(keys[s:e], pa.list_(pa.int64())), pa.array([tokens[k] for k in row[s:e]], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(made, names=names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["g", "root", "links", "others"])

        def finish() -> None:
            if len(g) < 2:
                return
            (key, p, q), sides = last, np.array(side)
            links, others, label = compare(key, tokens, keys, np.array(copies), sides if p != q else None)
            for k in np.flatnonzero(links).tolist():
                found.append((g[k], g[label[k]], int(links[k]), int(others[k])))

        last, g, tokens, keys, side, copies, found = None, [], [], [], [], [], []
        for batch in batches:
            at = list(zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q")), strict=True))
            flats = []
            for c in ("tokens", "keys"):
                col = batch.column(c)
                ends = np.cumsum([0, *col.value_lengths().to_pylist()])
                flat = col.flatten().to_numpy(zero_copy_only=False)
                flats.append([flat[a:b].copy() for a, b in zip(ends, ends[1:], strict=False)])
            for where, one, t, k, s, n in zip(at, batch.column("g").to_pylist(), *flats, *(batch.column(c).to_pylist() for c in ("side", "copies")), strict=True):
                if where != last:
                    finish()
                    last, g, tokens, keys, side, copies = where, [], [], [], [], []
                    if len(found) > 5000:
                        yield done(found)
                        found = []
                g.append(one), tokens.append(t), keys.append(k), side.append(s), copies.append(n)
        finish()
        yield done(found)

    texts = docs.join(asked.hint("merge"), ["f", "r"])
    rows = _hashed(texts).select("g", "n_copies", "held", "own", "words").mapInArrow(spread, "key bigint, p int, q int, side int, g binary, copies bigint, keys array<bigint>, tokens array<int>")
    dealt = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return dealt.mapInArrow(solve, "g binary, root binary, links bigint, others bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of ``edges`` (a, b) that is no root itself, by alternating large and small stars."""
    known = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
    before = None
    while True:
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        known = cut(small.unionByName(low.withColumnRenamed("m", "b")).filter("a <> b").distinct(), "near-stars")
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = known.groupBy("a").agg(F.min("b").alias("root"))
    return stars.withColumnRenamed("a", "node")


def classes(docs: DataFrame, target: float = TARGET_RECALL, small: int = SMALL, tokens: int = TOKENS) -> DataFrame:
    """f, r, doc_id, class_id (least doc_id of the class), n_links (different sets at the threshold or above), n_copies, n_doc_links (other documents at the threshold or above, copies included), first (least row of the class)."""
    bound_batches(docs.sparkSession, rows=500, mb=8)
    n_runs, repeats = runs(target)
    described = cut(_described(docs, n_runs), "near-described")
    reps = described.filter("g is not null").groupBy("g").agg(F.min(F.struct("f", "r")).alias("at"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    reps = cut(reps, "near-sets")
    members, sketches = reps.select("g", "at.f", "at.r", "n_copies"), reps.select("g", "sketch")
    pairs = reps.select("g", "n", F.explode("keys").alias("key"))
    buckets = None
    for depth in range(DEPTH + 1):
        ready, wide = _sorted_buckets(pairs, sketches, small, tokens, repeats)
        buckets = ready if buckets is None else buckets.unionByName(ready)
        if wide.isEmpty():
            break
        if depth == DEPTH:
            rest = _sizes(wide.join(reps.select("g", "n").hint("merge"), "g"))
            buckets = buckets.unionByName(wide.join(rest.hint("merge"), "key"))
            break
        paths = cut(_split(docs, wide, members, repeats), "near-paths")
        pairs = paths.join(reps.select("g", "n").hint("merge"), "g")
    found = cut(_linked(docs, buckets, members, small, tokens), "near-links")
    roots = components(found.select(F.col("g").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("g").agg(F.sum("links").alias("n_links"), F.sum("others").alias("others"))
    sets = reps.select("g", "n_copies").join(links.hint("merge"), "g", "left").join(roots.withColumnRenamed("node", "g").hint("merge"), "g", "left")
    sets = sets.select("g", "n_copies", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("others", F.lit(0).cast("bigint")).alias("others"), F.coalesce("root", "g").alias("root"))
    rows = described.select("f", "r", "doc_id", "g").join(sets.hint("merge"), "g", "left")
    rows = cut(rows, "near-rows")
    own = F.struct(F.col("doc_id"), F.col("f"), F.col("r"))
    least = cut(rows.filter("root is not null").groupBy("root").agg(F.min(own).alias("least")), "near-least")
    done = rows.join(least.hint("merge"), "root", "left")
    lone = F.col("root").isNull()
    return done.select(
        "f", "r", "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies"),
        F.coalesce(F.col("others") + F.col("n_copies") - 1, F.lit(0).cast("bigint")).alias("n_doc_links"),
        (lone | ((F.col("least.f") == F.col("f")) & (F.col("least.r") == F.col("r")))).alias("first"),
    )


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with f, r, file and row of each text, from its place ``_locator``."""
    row = F.substring_index("_locator", "#", -1)
    file = F.expr("substring(_locator, 1, length(_locator) - length(substring_index(_locator, '#', -1)))")
    return docs.withColumns({"f": F.xxhash64(file), "r": F.coalesce(row.cast("bigint"), F.lit(0).cast("bigint"))}).drop("_locator")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, n_doc_links of every document."""
    return classes(with_rows(located(docs.select("doc_id", "text"))), **options).select("doc_id", "class_id", "n_links", "n_copies", "n_doc_links")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The first document of each class, by doc_id, with its own columns."""
    docs = with_rows(packed(docs, "doc_id", "text"))
    first = cut(classes(docs.drop("_doc"), **options).filter("first").select("f", "r"), "near-first")
    return docs.join(first.hint("merge"), ["f", "r"]).select("_doc.*")
