"""Removal of long byte strings that occur more than once, by suffix arrays.

Every byte string of ``length`` bytes has an anchor, the place of the least
hash among its k-grams, so equal strings have equal anchors at equal places.
The strings of one anchor lie in one segment of its text. Segments whose
anchor hash occurs nowhere else repeat nothing; equal segments repeat each
other entirely. What is left, different segments of one anchor hash, meets
in a bucket. There segments are cut where any two of them part, which makes
short strings of symbols, and a suffix array of these, built by linear
grouping, shows for each place the longest string that occurs again.

A bucket of many segments would be one large task: its strings are counted
by digests instead, first in blocks of neighbouring places (a block whose
common core is unique holds no repeat), then one by one where a block is
undecided. That path is exact up to 64-bit digests and its rows grow with
the input, not with its square.

Defined results: a null text counts as empty; texts under ``length`` bytes
keep everything; copies, also of whole rows, remove each other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlore.llm.suffix_groups import suffix_array
from graphlore.plans.shared import bound_batches, cut, discard, located

LENGTH, GRAM = 400, 64
#: Most different segments that one suffix array takes; larger buckets are counted by digests.
BUCKET = 48
#: Neighbouring places that the digest path decides together.
BLOCK = 32
#: Buckets, in segments, whose suffixes are sorted at once.
AT_ONCE = 400
_CHUNK, _PLACES = (1 << 20) - 8192, (1 << 20) - 1


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of an odd multiplier and of its inverse."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    byte = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    m = 0x9E3779B97F4A7C15
    up = np.cumprod(np.full(_PLACES + 2, m, dtype=np.uint64))
    down = np.cumprod(np.full(_PLACES + 2, pow(m, -1, 1 << 64), dtype=np.uint64))
    return byte, up, down


_cache: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on, by one rolling sum."""
    if not _cache:
        _cache.append(_tables())
    byte, up, down = _cache[0]
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(byte[data] * down[:n], out=sums[1:])
    h = (sums[gram:] - sums[: n + 1 - gram]) * up[: n + 1 - gram]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """first start, last start, anchor place and anchor hash of each run of strings with one anchor.

    ``data``: texts end to end; ``ends``: where each ends. Long input is taken in pieces that overlap.
    """
    width, found = length - gram + 1, []
    stop = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    for s in range(0, len(data), _CHUNK):
        part = data[s : s + _CHUNK + length - 1]
        if len(part) < length:
            break
        h = gram_hashes(part, gram)
        keys = (h & ~np.uint64(_PLACES)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(keys)] = keys
        rows = padded.reshape(-1, width)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(keys) - width + 1
        least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
        at = (least & np.uint64(_PLACES)).astype(np.int64)
        n = min(n, _CHUNK)
        starts = np.flatnonzero(stop[s : s + n] - np.arange(s, s + n) >= length)
        if not len(starts):
            continue
        own = at[starts]
        new = np.flatnonzero((np.diff(own) != 0) | (np.diff(starts) != 1)) + 1
        first, last = np.concatenate(([0], new)), np.concatenate((new - 1, [len(starts) - 1]))
        q = own[first]
        found.append((starts[first] + s, starts[last] + s, q + s, h[q].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """f, r (file and row), lo (first start), n (starts), a (anchor's offset from lo), h (its hash), d (segment's digest)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["f", "r", "lo", "n", "a", "h", "d"]
        for batch in batches:
            texts = [x or b"" for x in batch.column("data").to_pylist()]
            whole = b"".join(texts)
            ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
            lo, hi, q, h = anchors(np.frombuffer(whole, dtype=np.uint8), ends, length, gram)
            doc = np.searchsorted(ends, lo, side="right")
            start = np.concatenate(([0], ends))[doc]
            d = [_digest(b"%d:" % (x - a) + whole[a : b + length]) for a, b, x in zip(lo.tolist(), hi.tolist(), q.tolist(), strict=True)]
            f, r = (batch.column(c).to_numpy()[doc] for c in ("f", "r"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f, r, lo - start, (hi - lo + 1).astype(np.int32), (q - lo).astype(np.int32), h, np.array(d, dtype=np.int64))], names=names)

    return docs.select("f", "r", "data").mapInArrow(find, "f bigint, r bigint, lo bigint, n int, a int, h bigint, d bigint")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _parts(sides: list[bytes]) -> list[int]:
    """Where any two of the strings part, and where they end; ascending, from 0."""
    ordered = sorted(sides)
    return sorted({0} | {len(x) for x in sides} | {_common(x, y) for x, y in zip(ordered, ordered[1:], strict=False)})


def repeated_starts(buckets: list[list[tuple[bytes, int, int, int]]], length: int) -> list[list[list[tuple[int, int]]]]:
    """For each bucket and segment the ranges of starts, from the segment's first, whose string is in another segment.

    A segment: its bytes, its anchor's offset, its number of starts, and how
    many places hold it. What several places hold is settled elsewhere.
    """
    text: list[int] = []
    ids: dict[tuple, int] = {}
    size: list[int] = [0]  # bytes of each symbol
    rows = []  # bucket, segment, its places in text by start offset, end
    for b, bucket in enumerate(buckets):
        lefts, rights = [s[:a][::-1] for s, a, _, _ in bucket], [s[a:] for s, a, _, _ in bucket]
        lcut, rcut = _parts(lefts), _parts(rights)
        for k in range(len(bucket)):
            places = {}
            for side, cuts, own in ((0, lcut, lefts[k]), (1, rcut, rights[k])):
                spans = [(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if y <= len(own)]
                for x, y in reversed(spans) if side == 0 else spans:
                    if side == 0:
                        places[y] = len(text)
                    elif x == 0:
                        places[0] = len(text)
                    key = (b, side, x, own[x:y])
                    i = ids.get(key)
                    if i is None:
                        i = ids[key] = len(ids) + 1
                        size.append(y - x)
                    text.append(i)
            rows.append((b, k, lcut, places, len(text)))
            text.append(0)
    order = suffix_array(text)
    rank = [0] * len(order)
    for k, s in enumerate(order):
        rank[s] = k

    def shared(i: int, j: int) -> int:
        n = 0
        while text[i] == text[j] and text[i]:
            n += size[text[i]]
            i, j = i + 1, j + 1
        return n

    out: list[list[list[tuple[int, int]]]] = [[[] for _ in bucket] for bucket in buckets]
    for b, k, lcut, places, _ in rows:
        _, anchor, n, held = buckets[b][k]
        if held > 1:
            continue
        low = anchor - n + 1
        for offset, at in places.items():
            r = rank[at]
            reach = max(shared(at, order[x]) for x in (r - 1, r + 1) if 0 <= x < len(order)) if len(order) > 1 else 0
            before = max((x for x in lcut if x < offset), default=-1)
            first, last = max(before + 1, length - (reach - offset), low), min(offset, anchor)
            if first <= last:
                out[b][k].append((anchor - last, anchor - first))
    return out


def _bucket_ranges(segments: DataFrame, length: int, at_once: int) -> DataFrame:
    """h, d, x1, x2 of segments in buckets of bounded size. The rows of a bucket come in a row, as they are dealt and sorted by h."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(buckets: list, keys: list) -> pa.RecordBatch:
            found = [(h, d, a, b) for bucket, key in zip(repeated_starts(buckets, length), keys, strict=True) for ranges, (h, d) in zip(bucket, key, strict=True) for a, b in ranges]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64() if k < 2 else pa.int32()) for k in range(4)], names=["h", "d", "x1", "x2"])

        buckets, keys, held, last = [], [], 0, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("h", "d", "data", "a", "n", "c")]
            for h, d, data, a, n, c in zip(*cols, strict=True):
                if h != last:
                    if held >= at_once:
                        yield done(buckets, keys)
                        buckets, keys, held = [], [], 0
                    buckets.append([])
                    keys.append([])
                    last = h
                buckets[-1].append((data, a, n, c))
                keys[-1].append((h, d))
                held += 1
        if buckets:
            yield done(buckets, keys)

    dealt = segments.repartition("h").sortWithinPartitions("h", "d")
    return dealt.mapInArrow(solve, "h bigint, d bigint, x1 int, x2 int")


def _block_digests(hot: DataFrame, length: int, block: int) -> DataFrame:
    """h, d, c, j (block of offsets), core (digest of what all strings of the block share), whole (of all its own bytes), x1, x2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, d, data, a, n, c in zip(*(batch.column(x).to_pylist() for x in ("h", "d", "data", "a", "n", "c")), strict=True):
                low = a - n + 1
                for j in range(low // block, a // block + 1):
                    first, last = max(low, j * block), min(a, j * block + block - 1)
                    core = data[a - min(j * block, a) : a + length - (j * block + block - 1)]
                    whole = b"%d:%d:" % (first, last) + data[a - last : a - first + length]
                    out.append((h, d, c, j, _digest(core), _digest(whole), a - last, a - first))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["h", "d", "c", "j", "core", "whole", "x1", "x2"])

    return hot.mapInArrow(run, "h bigint, d bigint, c bigint, j int, core bigint, whole bigint, x1 int, x2 int")


def _string_digests(hot: DataFrame, length: int) -> DataFrame:
    """h, d, c, x, w: a digest of each string from start x1 to x2 of a segment, with its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, d, c, data, a, x1, x2 in zip(*(batch.column(k).to_pylist() for k in ("h", "d", "c", "data", "a", "x1", "x2")), strict=True):
                out += [(h, d, c, x, _digest(b"%d:" % (a - x) + data[x : x + length])) for x in range(x1, x2 + 1)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["h", "d", "c", "x", "w"])

    return hot.mapInArrow(run, "h bigint, d bigint, c bigint, x int, w bigint")


def _hot_ranges(hot: DataFrame, length: int, block: int) -> DataFrame:
    """h, d, x1, x2 of segments in buckets too large for one suffix array."""
    blocks = cut(_block_digests(hot, length, block), "repeats-blocks")
    kinds = blocks.groupBy("h", "j", "core", "whole").agg(F.sum("c").alias("places"), F.min("d").alias("d0"))
    kinds = cut(kinds, "repeats-kinds")
    settled = blocks.join(kinds.filter("places > 1").select("h", "j", "core", "whole").hint("merge"), ["h", "j", "core", "whole"]).select("h", "d", "x1", "x2")
    # blocks whose core is in two kinds: their strings are compared, one segment standing for each kind
    several = kinds.groupBy("h", "j", "core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    asked = kinds.join(several.hint("merge"), ["h", "j", "core"]).select("h", F.col("d0").alias("d"), "j", "places")
    ranged = asked.join(blocks.select("h", "d", "j", "x1", "x2").hint("merge"), ["h", "d", "j"]).groupBy("h", "d").agg(F.collect_list(F.struct("x1", "x2", "places")).alias("spans"))
    open_rows = hot.select("h", "d", "data", "a").join(ranged.hint("merge"), ["h", "d"]).withColumn("s", F.explode("spans"))
    strings = _string_digests(open_rows.select("h", "d", F.col("s.places").alias("c"), "data", "a", F.col("s.x1").alias("x1"), F.col("s.x2").alias("x2")), length)
    strings = cut(strings, "repeats-strings")
    again = strings.groupBy("h", "w").agg(F.sum("c").alias("places")).filter("places > 1").select("h", "w")
    single = strings.filter("c = 1").join(again.hint("merge"), ["h", "w"]).select("h", "d", F.col("x").alias("x1"), F.col("x").alias("x2"))
    return settled.unionByName(single)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """f, r and ``spans``, an array of byte ranges (ends exclusive, overlapping) to remove, of each text that has any."""
    if not 0 < gram <= length or not 0 < block <= length:
        raise ValueError("a k-gram and a block are no longer than a string")
    bound_batches(docs.sparkSession, rows=1000, mb=1)
    found = cut(occurrences(docs, length, gram), "repeats-anchors")
    # counts are written before the join, whose hot hashes can then be split: an aggregate above it would bind them
    again = cut(found.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h"), "repeats-again")
    shared = cut(found.join(again.hint("merge"), "h"), "repeats-shared")
    discard(found)
    place = F.struct("f", "r", "lo", "n", "a")
    kinds = shared.groupBy("h", "d").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("at"))
    kinds = cut(kinds, "repeats-kinds")
    sizes = cut(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "repeats-sizes")
    asked = kinds.join(sizes.hint("merge"), "h").select("at.f", "at.r", F.struct("h", "d", "c", "m", "at.lo", "at.n", "at.a").alias("s"))
    asked = asked.groupBy("f", "r").agg(F.collect_list("s").alias("all"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "d", "c", "m", "n", "a", "data"]
        for batch in batches:
            out = []
            for data, all_ in zip(batch.column("data").to_pylist(), batch.column("all").to_pylist(), strict=True):
                out += [(s["h"], s["d"], s["c"], s["m"], s["n"], s["a"], data[s["lo"] : s["lo"] + s["n"] - 1 + length]) for s in all_]
            kinds_ = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds_)], names=names)

    texts = docs.select("f", "r", "data").join(asked.hint("merge"), ["f", "r"]).select("data", "all")
    segments = cut(texts.mapInArrow(extract, "h bigint, d bigint, c bigint, m bigint, n int, a int, data binary"), "repeats-segments")
    ranges = _bucket_ranges(segments.filter(F.col("m") <= bucket), length, AT_ONCE)
    hot = segments.filter(F.col("m") > bucket)
    if not hot.isEmpty():
        ranges = ranges.unionByName(_hot_ranges(hot, length, block))
    ranges = ranges.groupBy("h", "d").agg(F.collect_list(F.struct("x1", "x2")).alias("ranges"))
    ranges = cut(ranges, "repeats-ranges")
    every = kinds.filter("c > 1").select("h", "d", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges"))
    every = every.unionByName(ranges.join(kinds.filter("c > 1").select("h", "d").hint("merge"), ["h", "d"], "left_anti"))
    hits = shared.join(every.hint("merge"), ["h", "d"])
    whole = F.array(F.struct(F.lit(0).alias("x1"), (F.col("n") - 1).alias("x2")))
    span = F.explode(F.coalesce("ranges", whole))
    hits = hits.select("f", "r", "lo", span.alias("x")).select("f", "r", F.struct((F.col("lo") + F.col("x.x1")).alias("s"), (F.col("lo") + F.col("x.x2") + length).alias("e")).alias("span"))
    return hits.groupBy("f", "r").agg(F.collect_list("span").alias("spans"))


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with f, r (file and row of each text) and its UTF-8 bytes as ``data``."""
    docs = located(docs).withColumn("_row", F.substring_index("_locator", "#", -1).cast("bigint"))
    file = F.xxhash64(F.expr("substring(_locator, 1, length(_locator) - length(substring_index(_locator, '#', -1)))"))
    own = docs.withColumns({"f": file, "r": F.coalesce("_row", F.lit(0).cast("bigint"))})
    return own.withColumn("data", F.coalesce("text", F.lit("")).cast("binary"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every document."""
    rows = with_rows(docs.select("doc_id", "text"))
    spans = cut(repeated_spans(rows, length, gram, bucket, block), "repeats-spans")

    @F.pandas_udf("struct<n_removed:bigint,n_spans:bigint,kept:binary>")
    def strip(data: pd.Series, all_spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(data, all_spans, strict=True):
            if own is None:
                out.append((0, 0, None))
                continue
            kept, at, end, n, removed = [], 0, -1, 0, 0
            for s, e in sorted((x["s"], x["e"]) for x in own):
                if s > end:
                    n += 1
                    kept.append(text[at:s])
                    removed += e - s
                else:
                    removed += max(0, e - end)
                end = max(end, e)
                at = end
            kept.append(text[at:])
            out.append((removed, n, b"".join(kept)))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    joined = rows.select("f", "r", "doc_id", "data").join(spans.hint("merge"), ["f", "r"], "left")
    # texts without spans stay in the JVM
    held: Column = F.when(F.col("spans").isNotNull(), F.col("data"))
    done = joined.withColumn("_cut", strip(held, F.col("spans")))
    return done.select("doc_id", F.octet_length("data").cast("bigint").alias("n_bytes"), "_cut.n_removed", "_cut.n_spans", F.coalesce("_cut.kept", "data").alias("kept"))
