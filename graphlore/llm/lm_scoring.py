"""Log-probabilities of texts under a language model with deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of its bigram and
its unigram with a uniform share for every known word and one unknown word.
The weights depend on how frequent the context is, in buckets of powers of
two; expectation maximisation learns them on the counts of a part of the
training texts that is deleted from the counts being mixed.

Words are 64-bit hashes. The 2^18 most frequent ones have ranks, their counts
go to every task, and so do those of pairs that make up 2^-14 of all tokens or
more (at most 2^14 pairs); nothing that large meets in one task. All other
occurrences are dealt by hash in packed rows: first those of rarer words, by
the word, which finds its count, then pairs, by their context if it is rare
(its pairs add up to its count) and by the pair if it is frequent. Sums by
text go back to blocks of 4,096 neighbouring rows. Everything gathered grows
with the tokens; a copy of a text costs what another text costs.

Defined results: a null or empty text has the token of its end only; a null
identifier counts as an empty one, so its text trains; copies and repeated
rows count and are scored each; without a training text every token has
probability 1; other columns are ignored; an empty table gives an empty
result. Equal hashes of different words (one in 2^64 pairs) count as one word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlore.plans.shared import bound_batches, cut, located

#: Words, and the share of all tokens (one in so many) of pairs, whose counts every task has.
HEAD, PAIR_SHARE = 1 << 18, 1 << 14
#: Tokens that a task packs at once, tokens of one bucket, rows of one block of texts.
UNIT, BUCKET, BLOCK = 1 << 20, 1 << 21, 12
#: Of the training texts one in so many is deleted from the counts and weighs the mixture.
DELETED = 10
#: Steps of a logarithm to base 2 by which equal cases are told apart when weights are learned; values are averaged, not rounded.
STEPS = 4
LEAST_WEIGHT = 1e-6
RARE = np.uint64(1 << 63)
#: The hash of a text's end, which no word stands for.
END = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that are hashed at once, and bits of the hash that find a rank.
PIECE, SLOT = 1 << 19, 20
_MULTIPLIER, _NEAR = 0xD1342543DE82EF95, 16


def _powers(step: int, n: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_BYTE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 64, 256, dtype=np.uint64)
_BYTE[SPACE] = 0
_UP, _UP_FAR = _powers(_MULTIPLIER, 1 << _NEAR), _powers(pow(_MULTIPLIER, 1 << _NEAR, 1 << 64), 1 << 15)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts in UTF-8 with A-Z lowered, and how many words each text has.

    A word's hash is a polynomial in random numbers for its bytes, modulo 2^64, mixed.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    word = ~SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    starts = np.flatnonzero(begins)
    ends = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), per_text
    values = _BYTE[data[starts[0] :]]
    at = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    far = at >> _NEAR
    if far.any():
        values = values * _UP_FAR[far % len(_UP_FAR)]
    values = values * _UP[at & ((1 << _NEAR) - 1)]
    return _mixed(np.add.reduceat(values, starts - starts[0])), per_text


def squeeze(values: np.ndarray) -> bytes:
    """Numbers, compressed by the places of their bytes."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()) if len(values) else b""


def expand(blob: bytes, kind: type) -> np.ndarray:
    if not blob:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _mixed(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """A hash of one or two codes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b if isinstance(b, np.ndarray) else np.uint64(b)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pair_bucket(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs of a rare context meet in one bucket; those of a frequent one are spread."""
    return (_mixed(first, np.where(first < RARE, second, np.uint64(0))) % np.uint64(buckets)).astype(np.int64)


class Ranks:
    """Codes of hashed words: the rank of a frequent one, else its hash with the top bit set."""

    def __init__(self, hashes: np.ndarray):
        self.rank = np.argsort(hashes)
        self.sorted = hashes[self.rank]
        self.slots = np.searchsorted(self.sorted >> np.uint64(64 - SLOT), np.arange((1 << SLOT) + 1, dtype=np.uint64))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        out = hashes | RARE
        slot = (hashes >> np.uint64(64 - SLOT)).astype(np.int64)
        at, end = self.slots[slot], self.slots[slot + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.sorted[here] == hashes[left]
            out[left[hit]] = self.rank[here[hit]].astype(np.uint64)
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


@dataclass
class Counts:
    """What every task knows: counts of frequent words by rank, and totals of the training tokens."""

    hashes: np.ndarray
    trained: np.ndarray
    deleted: np.ndarray
    tokens: int
    tokens_deleted: int
    words: int
    buckets: int

    def ranks(self) -> Ranks:
        return Ranks(self.hashes)

    def base(self, trained: np.ndarray) -> np.ndarray:
        return np.log10((trained + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def look(self, codes: np.ndarray, own: np.ndarray | None, column: np.ndarray) -> np.ndarray:
        """Counts of codes: of frequent words from ``column``, of rare ones from ``own``."""
        frequent = codes < RARE
        out = np.zeros(len(codes)) if own is None else own.astype(float)
        out[frequent] = column[codes[frequent].astype(np.int64)]
        return out


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 more than the power of two in its count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def learn_weights(cells: list[tuple], words: int, rounds: int = 200) -> np.ndarray:
    """Weights (64 buckets by bigram, unigram, uniform) of held-out cases: (bucket, weight, bigram estimate, unigram estimate)."""
    found = np.full((64, 3), np.nan)
    table = np.array(cells, float).reshape(-1, 4)
    for b in np.unique(table[:, 0]).astype(int):
        mine = table[table[:, 0] == b]
        parts = np.stack([mine[:, 2], mine[:, 3], np.full(len(mine), 1 / (words + 1))], axis=1)
        lam = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = lam * parts
            share /= share.sum(axis=1, keepdims=True)
            lam = (share * mine[:, 1:2]).sum(axis=0) / mine[:, 1].sum()
            lam = np.maximum(lam, LEAST_WEIGHT)
            lam /= lam.sum()
        found[b] = lam
    last = np.array([0.4, 0.5, 0.1])
    for b in range(64):
        if np.isnan(found[b, 0]):
            found[b] = last if b else [0, 0.9, 0.1]
        elif b:
            last = found[b]
    return found


class Model:
    def __init__(self, counts: Counts, weights: np.ndarray):
        self.counts, self.weights = counts, weights

    def log10(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of tokens whose pair, context and word have so many training occurrences."""
        if not self.counts.tokens:
            return np.zeros(len(pair))
        lam = self.weights[bucket_of(context)]
        return np.log10(lam[:, 0] * pair / np.maximum(context, 1) + lam[:, 1] * word / self.counts.tokens + lam[:, 2] / (self.counts.words + 1))


# rows that tasks exchange: their kind, where they go, packed columns
ROWS = "kind string, bucket int, file bigint, block bigint, x array<binary>"


def _rows(made: list[tuple]) -> pa.RecordBatch:
    kinds, buckets, files, blocks, xs = zip(*made, strict=True) if made else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(buckets, pa.int32()), pa.array(files, pa.int64()), pa.array(blocks, pa.int64()), pa.array(xs, pa.list_(pa.binary()))],
        ["kind", "bucket", "file", "block", "x"],
    )


def _stretches(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches, from flags of where one begins."""
    at = np.flatnonzero(starts).tolist()
    return zip(at, [*at[1:], len(starts)], strict=False)


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys differ from those before."""
    flags = np.zeros(len(keys[0]), bool)
    flags[:1] = True
    for k in keys:
        flags[1:] |= k[1:] != k[:-1]
    return flags


def _by_block(kind: str, files: np.ndarray, rows: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """One packed row for each block of texts; the texts in any order."""
    order = np.lexsort((rows, files))
    files, rows, columns = files[order], rows[order], [c[order] for c in columns]
    blocks = rows >> BLOCK
    return [(kind, None, int(files[s]), int(blocks[s]), [squeeze(c[s:e]) for c in (rows, *columns)]) for s, e in _stretches(_begins(files, blocks))]


@dataclass
class Unit:
    """Occurrences of some texts: word, the word before it (or the end), the text's number; the texts' rows and parts."""

    first: np.ndarray
    second: np.ndarray
    at: np.ndarray
    files: np.ndarray
    rows: np.ndarray
    parts: np.ndarray
    lengths: np.ndarray


def _units(batches: Iterable[pa.RecordBatch], ranks: Ranks | None = None) -> Iterator[Unit]:
    """Texts (file, row, part, text) in units of about ``UNIT`` tokens; without ``ranks`` words are their hashes."""
    code = ranks.codes if ranks else lambda h: h
    end = code(np.array([END], np.uint64))
    held, texts, seqs, lengths, size, waiting = [], [], [], [], 0, 0

    def encode() -> int:
        words, n = hash_words(texts)
        whole = np.empty(len(words) + len(texts), np.uint64)
        last = np.cumsum(n + 1) - 1
        inside = np.ones(len(whole), bool)
        inside[last] = False
        whole[inside], whole[last] = code(words), end
        seqs.append(whole)
        lengths.append(n + 1)
        texts.clear()
        return len(whole)

    def unit() -> Unit:
        second, n = np.concatenate(seqs), np.concatenate(lengths)
        files, rows, parts = (np.array(c) for c in zip(*held, strict=True))
        return Unit(np.r_[end, second[:-1]], second, np.repeat(np.arange(len(n)), n), files.astype(np.int64), rows.astype(np.int64), parts.astype(np.int8), n)

    for batch in batches:
        for file, row, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append((file, row, part))
            texts.append(text)
            waiting += len(text)
            if waiting >= PIECE:
                size, waiting = size + encode(), 0
                if size >= UNIT:
                    yield unit()
                    held, seqs, lengths, size = [], [], [], 0
    if texts:
        encode()
    if held:
        yield unit()


def _dealt(kind: str, bucket: np.ndarray, u: Unit, keep: np.ndarray, *more: np.ndarray) -> list[tuple]:
    """Kept occurrences as one packed row for each bucket, with the texts that they are of."""
    mine = bucket[keep]
    keep = keep[np.argsort(mine.astype(np.uint16) if mine.max(initial=0) < 1 << 16 else mine, kind="stable")]
    mine = bucket[keep]
    out = []
    for s, e in _stretches(_begins(mine)):
        k = keep[s:e]
        new = _begins(u.at[k])  # in order, as their sort was stable
        texts, at = u.at[k][new], np.cumsum(new) - 1
        out.append((kind, int(mine[s]), None, None, [squeeze(c) for c in (u.first[k], u.second[k], at.astype(np.uint32), u.files[texts], u.rows[texts], u.parts[texts], *(m[k] for m in more))]))
    return out


def _gathered(table: pa.Table) -> tuple[Unit, np.ndarray | None, np.ndarray | None]:
    """Occurrences of one bucket out of their packed rows; counts of the words themselves where a row has them."""
    first, second, at, files, rows, parts, trained, deleted, base = [], [], [], [], [], [], [], [], 0
    for x in table["x"].to_pylist():
        first.append(expand(x[0], np.uint64))
        second.append(expand(x[1], np.uint64))
        at.append(expand(x[2], np.uint32).astype(np.int64) + base)
        files.append(expand(x[3], np.int64))
        rows.append(expand(x[4], np.int64))
        parts.append(expand(x[5], np.int8))
        base += len(rows[-1])
        for column, k in ((trained, 6), (deleted, 7)):
            column.append(expand(x[k], np.int64) if len(x) > k else np.zeros(len(first[-1]), np.int64))
    join = lambda a, kind: np.concatenate(a) if a else np.empty(0, kind)
    u = Unit(join(first, np.uint64), join(second, np.uint64), join(at, np.int64), join(files, np.int64), join(rows, np.int64), join(parts, np.int8), np.empty(0))
    return u, join(trained, np.int64), join(deleted, np.int64)


def _sums(u: Unit, *values: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(u.at, weights=v, minlength=len(u.rows)) for v in values]


class Plan:
    """The jobs of one scoring, over texts (file, row, part, text)."""

    def __init__(self, docs: DataFrame, part: Column):
        bound_batches(docs.sparkSession)
        self.spark = docs.sparkSession
        placed = located(docs.select("doc_id", part.alias("part"), F.coalesce("text", F.lit("")).alias("text")), "locator")
        file, row = F.xxhash64(F.regexp_replace("locator", "#[0-9]+$", "")), F.substring_index("locator", "#", -1).cast("bigint")
        self.docs = placed.select("doc_id", "part", file.alias("file"), row.alias("row"), F.col("text").cast("binary").alias("text"))
        self.texts = self.docs.select("file", "row", "part", "text")

    def count(self, head: int, buckets: int | None) -> Counts:
        """Counts of all words; the most frequent of them and the totals come to the driver."""
        words = cut(self.texts.mapInArrow(_count_words, "h bigint, n bigint, trained bigint, deleted bigint").groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n", "trained", "deleted")]), "lm-words")
        total = words.agg(F.sum("n"), F.sum("trained"), F.sum("deleted"), F.count(F.when(F.col("trained") > 0, 1))).first()
        top = words.orderBy(F.desc("n"), "h").limit(head).toArrow()
        column = lambda c: top[c].to_numpy().astype(np.int64)
        every, trained, deleted, known = (int(x or 0) for x in total)
        if buckets is None:
            buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), every // BUCKET + 1)
        return Counts(column("h").view(np.uint64), column("trained"), column("deleted"), trained, deleted, known, buckets)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words with how often they occur in all texts, in training texts and in deleted ones."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        h, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        keys, at = np.unique(h, return_inverse=True)
        sums = [np.bincount(at, weights=n[:, k], minlength=len(keys)).astype(np.int64) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (keys.view(np.int64), *sums)], ["h", "n", "trained", "deleted"])

    for u in _units(batches):
        part = u.parts[u.at]
        for p in range(3):
            keys, n = np.unique(u.second[part == p], return_counts=True)
            held.append((keys, np.outer(n, [1, p > 0, p == 2])))
            size += len(keys)
        if size >= UNIT:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def score(docs: DataFrame, folds: int = 5, left_out: int = 1, head: int = HEAD, buckets: int | None = None, pair_share: int = PAIR_SHARE) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (unigrams, half a count added) and ``score`` of each row.

    Texts whose crc32(doc_id) % ``folds`` is ``left_out`` don't train.
    """
    if head > HEAD:
        raise ValueError(f"ranks have 18 bits: head is at most {HEAD}")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    part = F.when(h % folds == left_out, 0).when(F.floor(h / folds) % DELETED == 0, 2).otherwise(1).cast("int")
    plan = Plan(docs, part)
    spark = plan.spark
    known = spark.sparkContext.broadcast(plan.count(head, buckets))

    def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text its length and what its frequent words come to; occurrences of rare words, by the word."""
        counts = known.value
        base, ranks = counts.base(counts.trained), counts.ranks()
        for u in _units(batches, ranks):
            frequent = u.second < RARE
            value, seen = np.zeros(len(u.second)), np.zeros(len(u.second))
            value[frequent] = base[u.second[frequent].astype(np.int64)]
            seen[frequent] = counts.trained[u.second[frequent].astype(np.int64)] > 0
            sums, n_known = _sums(u, value, seen)
            yield _rows(_by_block("text", u.files, u.rows, u.lengths.astype(np.int64), n_known.astype(np.int64), sums))
            yield _rows(_dealt("rare", (_mixed(u.second) % np.uint64(counts.buckets)).astype(np.int64), u, np.flatnonzero(~frequent)))

    def count_rare(table: pa.Table) -> pa.Table:
        """Counts of rare words: what they add to the base of their texts, and their pairs with these counts."""
        counts = known.value
        u, _, _ = _gathered(table)
        _, at = np.unique(u.second, return_inverse=True)
        part = u.parts[u.at]
        trained, deleted = (np.bincount(at, weights=w).astype(np.int64)[at] if len(at) else at for w in (part > 0, part == 2))
        sums, n_known = _sums(u, counts.base(trained), trained > 0)
        made = _by_block("base", u.files, u.rows, n_known.astype(np.int64), sums)
        made += _dealt("pair", pair_bucket(u.first, u.second, counts.buckets), u, np.arange(len(at)), trained, deleted)
        return pa.Table.from_batches([_rows(made)])

    first = cut(plan.texts.mapInArrow(rare, ROWS), "lm-rare")
    rarest = cut(first.filter("kind = 'rare'").groupBy("bucket").applyInArrow(count_rare, ROWS), "lm-pairs")
    pairs = rarest.filter("kind = 'pair'")

    def count_frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of frequent words, counted within a unit."""
        counts = known.value
        ranks = counts.ranks()
        for u in _units(batches, ranks):
            part = u.parts[u.at]
            keep = (u.second < RARE) & (part > 0)
            a, b, gone = u.first[keep], u.second[keep], (part[keep] == 2).astype(np.uint64)
            both = a < RARE
            key, n = np.unique((a[both] << np.uint64(19)) | (b[both] << np.uint64(1)) | gone[both], return_counts=True)
            a, b = np.r_[a[~both], key >> np.uint64(19)], np.r_[b[~both], (key >> np.uint64(1)) & np.uint64(HEAD - 1)]
            gone, n = np.r_[gone[~both], key & np.uint64(1)].astype(np.int64), np.r_[np.ones(len(a) - len(key), np.int64), n]
            bucket = pair_bucket(a, b, counts.buckets)
            order = np.argsort(bucket.astype(np.uint16) if counts.buckets < 1 << 16 else bucket, kind="stable")
            made = []
            for s, e in _stretches(_begins(bucket[order])):
                k = order[s:e]
                made.append(("count", int(bucket[k[0]]), None, None, [squeeze(c) for c in (a[k], b[k], n[k], n[k] * gone[k])]))
            yield _rows(made)

    def cases(table: pa.Table) -> pa.Table:
        """Held-out cases, those alike together, and the most frequent pairs."""
        counts = known.value
        kinds = np.array(table["kind"].to_pylist())
        u, word_n, word_d = _gathered(table.filter(pa.array(kinds == "pair")))
        part = u.parts[u.at]
        a, b, n, d, wn, wd = [u.first], [u.second], [(part > 0).astype(np.int64)], [(part == 2).astype(np.int64)], [word_n], [word_d]
        for x in table.filter(pa.array(kinds == "count"))["x"].to_pylist():
            for column, k, kind in ((a, 0, np.uint64), (b, 1, np.uint64), (n, 2, np.int64), (d, 3, np.int64)):
                column.append(expand(x[k], kind))
            wn.append(np.zeros(len(a[-1]), np.int64))
            wd.append(wn[-1])
        a, b, n, d, wn, wd = (np.concatenate(x) for x in (a, b, n, d, wn, wd))
        _, at, back = np.unique(_mixed(a, b), return_index=True, return_inverse=True)
        n, d = (np.bincount(back, weights=x, minlength=len(at)) for x in (n, d))
        a, b, wn, wd = a[at], b[at], wn[at], wd[at]
        word = counts.look(b, wn - wd, counts.trained - counts.deleted)
        _, of = np.unique(a, return_inverse=True)
        context = counts.look(a, np.bincount(of, weights=n - d)[of] if len(of) else None, counts.trained - counts.deleted)
        held = d > 0
        bigram = ((n - d) / np.maximum(context, 1))[held]
        unigram = word[held] / max(counts.tokens - counts.tokens_deleted, 1)
        step = lambda x: np.where(x > 0, np.round(STEPS * np.log2(np.maximum(x, 1e-300))), 1).astype(np.int64)
        where = np.stack([bucket_of(context[held]), step(bigram), step(unigram)], axis=1)
        cell, back = np.unique(where, axis=0, return_inverse=True)
        w = d[held]
        sums = [np.bincount(back.reshape(-1), weights=v, minlength=len(cell)) for v in (w, w * bigram, w * unigram)]
        hot = np.flatnonzero((n * pair_share >= counts.tokens) & (a < RARE) & (b < RARE))
        code = (a[hot].astype(np.int64) << 18) | b[hot].astype(np.int64)
        none = np.full(len(hot), -1)
        columns = [np.r_[cell[:, 0], none], np.r_[cell[:, 1], code], np.r_[cell[:, 2], none], np.r_[sums[0], n[hot]], np.r_[sums[1], none], np.r_[sums[2], none]]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns[:3]] + [pa.array(c.astype(float)) for c in columns[3:]], ["b", "q2", "q1", "w", "s2", "s1"])

    both = plan.texts.filter("part > 0").mapInArrow(count_frequent, ROWS).unionByName(pairs)
    found = cut(both.groupBy("bucket").applyInArrow(cases, "b bigint, q2 bigint, q1 bigint, w double, s2 double, s1 double"), "lm-cases")
    cells = found.filter("b >= 0").groupBy("b", "q2", "q1").agg(F.sum("w").alias("w"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).collect()
    hot = found.filter("b < 0").select("q2", "w").toArrow()
    weights = learn_weights([(c.b, c.w, c.s2 / c.w, c.s1 / c.w) for c in cells], known.value.words)
    order = np.argsort(hot["q2"].to_numpy())
    frequent_pairs = spark.sparkContext.broadcast((hot["q2"].to_numpy()[order], hot["w"].to_numpy()[order], weights))

    def frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Probabilities of the most frequent pairs, and all other pairs of a frequent word."""
        counts, (codes, n, lam) = known.value, frequent_pairs.value
        ranks = counts.ranks()
        a, b = codes >> 18, codes & (HEAD - 1)
        value = Model(counts, lam).log10(n, counts.trained[a].astype(float), counts.trained[b].astype(float)) if len(codes) else np.empty(0)
        for u in _units(batches, ranks):
            keep = u.second < RARE
            if len(codes):
                own = np.flatnonzero(keep & (u.first < RARE))
                code = (u.first[own].astype(np.int64) << 18) | u.second[own].astype(np.int64)
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                same = codes[at] == code
                keep[own[same]] = False
                sums = np.bincount(u.at[own[same]], weights=value[at[same]], minlength=len(u.rows))
                yield _rows([(kind, block % counts.buckets, file, block, x) for kind, _, file, block, x in _by_block("sum", u.files, u.rows, sums.astype(np.float32))])
            yield _rows(_dealt("pair", pair_bucket(u.first, u.second, counts.buckets), u, np.flatnonzero(keep)))

    def probabilities(table: pa.Table) -> pa.Table:
        counts, (_, _, lam) = known.value, frequent_pairs.value
        sums = pa.array(np.array(table["kind"].to_pylist()) == "sum")
        done = table.filter(sums)
        u, own, _ = _gathered(table.filter(pc.invert(sums)))
        trains = (u.parts > 0)[u.at]
        _, of = np.unique(_mixed(u.first, u.second), return_inverse=True)
        pair = np.bincount(of, weights=trains)[of]
        _, of = np.unique(u.first, return_inverse=True)
        context = counts.look(u.first, np.bincount(of, weights=trains)[of], counts.trained)
        (sums,) = _sums(u, Model(counts, lam).log10(pair, context, counts.look(u.second, own, counts.trained)))
        return pa.concat_tables([done, pa.Table.from_batches([_rows(_by_block("sum", u.files, u.rows, sums.astype(np.float32)))]).cast(done.schema)])

    sums = plan.texts.mapInArrow(frequent, ROWS).unionByName(pairs).groupBy("bucket").applyInArrow(probabilities, ROWS)
    parts = first.filter("kind = 'text'").unionByName(rarest.filter("kind = 'base'")).unionByName(sums)
    totals = parts.groupBy("file", "block").applyInArrow(_totals, "file bigint, row bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    asked = plan.docs.select("file", "row", "doc_id", (F.col("part") == 0).alias("held_out"))
    return asked.join(totals.hint("merge"), ["file", "row"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(known.value.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def _totals(table: pa.Table) -> pa.Table:
    """Sums of the texts of one block over all that was found out about them."""
    size = 1 << BLOCK
    lengths, known, base, score, there = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size, bool)
    for kind, x in zip(table["kind"].to_pylist(), table["x"].to_pylist(), strict=True):
        at = expand(x[0], np.int64) & (size - 1)
        if kind == "sum":
            np.add.at(score, at, expand(x[1], np.float32))  # a text may come twice, from packed rows of its frequent and its rare words
            continue
        if kind == "text":
            there[at], lengths[at] = True, expand(x[1], np.int64)
        np.add.at(known, at, expand(x[-2], np.int64))
        np.add.at(base, at, expand(x[-1], np.float64))
    at = np.flatnonzero(there)
    whole = lambda name: np.full(len(at), table[name][0].as_py(), np.int64)
    columns = {"file": whole("file"), "row": (whole("block") << BLOCK) + at, "n_tokens": lengths[at], "n_known": known[at], "base_score": base[at], "score": score[at]}
    return pa.table({k: pa.array(v) for k, v in columns.items()})
