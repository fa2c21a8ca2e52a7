"""Spelling variants: words one edit apart, found through a reduced alphabet, and the form that each is a slip of.

Letters are hashed to a few symbols. All words of one reduced spelling are a
class; two words one edit apart have reduced spellings that are equal or one
edit apart. So every class generates the full one-edit neighbourhood of its
reduced spelling over the few symbols, which is joined with the reduced
vocabulary, and only words of classes that met are compared letter by letter.
The number of symbols grows slowly with the vocabulary, so that classes stay
small; every number of symbols gives the same result. Where a class is large
nevertheless, its words are not compared with each other: words of the smaller
class of the two generate their variants over the whole alphabet, as far as
these fall in the other class, and those are joined with the vocabulary.

Defined results: a null text has no words, a null identifier counts as an
empty one; copies and repeated rows count each time; ties between forms go to
the first in code-point order; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlore.plans.shared import bound_batches, cut, discard

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as its variant.
RATIO = 10
#: Occurrences of which one in so many, by hash, loses a letter (a test of robustness that the caller may leave out).
SLIP = 31
#: Most words of a class that are compared with those of another one by one.
CLASS = 512
#: Letters in the order of their frequency, so that symbols share frequent ones out; fixed values.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz" + "".join(map(chr, range(0xC0, 0x100)))
#: Different words that a task counts before it passes them on.
HELD = 400_000


def runs(text: str, least: int = LEAST_LENGTH) -> list[str]:
    """Maximal runs of letters with A-Z lowered, those of at least ``least`` code points."""
    return re.findall(rf"[a-zÀ-ÿ]{{{least},}}", text.encode().lower().decode())


def slipped(run: str, begun: int, slip: int | None) -> str:
    """The run, or where its hash says so the run without a letter; ``begun``: hash of what stands before it."""
    if slip and (h := zlib.crc32(run.encode(), begun)) % slip == 0:
        return run[: h % len(run)] + run[h % len(run) + 1 :]
    return run


def vocabulary(docs: DataFrame, slip: int | None = SLIP) -> DataFrame:
    """``word`` and ``n`` of every word of at least seven code points that occurs at least twice."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begun = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(runs(text)).items():
                    word = slipped(run, begun, slip)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def symbols_for(words: int) -> int:
    """So many symbols that spellings of usual length outnumber the words."""
    return max(4, math.ceil(max(words, 1) ** (1 / 11)))


def alphabet(symbols: int) -> tuple[str, str]:
    """Letters and the symbol that each is hashed to."""
    return LETTERS, "".join(chr(97 + k % symbols) for k in range(len(LETTERS)))


def neighbourhood(word: str, letters: str) -> set[str]:
    """The word and all that is one edit away over ``letters``."""
    found = {word}
    for k in range(len(word) + 1):
        head, tail = word[:k], word[k:]
        found.update(head + c + tail for c in letters)
        if tail:
            found.add(head + tail[1:])
            found.update(head + c + tail[1:] for c in letters)
    return found


def _met(classes: DataFrame, symbols: int) -> DataFrame:
    """Pairs of classes whose reduced spellings are equal or one edit apart, each once: ``a`` <= ``b``."""
    few = "".join(chr(97 + k) for k in range(symbols))

    def generate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reduced = batch.column(0).to_pylist()
            for at in range(0, len(reduced), 500):
                a, b = [], []
                for word in reduced[at : at + 500]:
                    near = [x for x in neighbourhood(word, few) if x >= word]
                    a += [word] * len(near)
                    b += near
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    probes = classes.select("reduced").mapInArrow(generate, "a string, b string")
    return probes.join(classes.select(F.col("reduced").alias("b")).hint("merge"), "b", "left_semi").select("a", "b")


def _one_edit(u: Column, v: Column) -> Column:
    return F.levenshtein(u, v, 1) == 1


def near_pairs(words: DataFrame, symbols: int | None = None, most: int = CLASS) -> DataFrame:
    """Every two words of ``words`` (``word``, ``n``; a table that :func:`cut` wrote) one edit apart, in both directions: ``word``, ``other``, ``other_n``."""
    letters, hashed = alphabet(symbols or symbols_for(words.count()))
    few = len(set(hashed))
    reduced = F.translate("word", letters, hashed).alias("reduced")
    sizes = words.select(reduced).groupBy("reduced").agg(F.count(F.lit(1)).alias("size"))
    small = (
        words.select(reduced, "word", "n").join(sizes.filter(F.col("size") <= most).hint("merge"), "reduced")
        .groupBy("reduced").agg(F.collect_list(F.struct("word", "n")).alias("words"), F.first("size").alias("size"))
    )
    large = sizes.filter(F.col("size") > most).select("reduced", F.lit(None).cast("array<struct<word:string,n:bigint>>").alias("words"), "size")
    classes = cut(small.unionByName(large), "spelling-classes")
    met = cut(_met(classes, few), "spelling-met")
    side = lambda x: classes.select(F.col("reduced").alias(x), F.col("words").alias(f"{x}_words"), F.col("size").alias(f"{x}_size"))
    both = met.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")

    found = F.flatten(F.transform("a_words", lambda u: F.transform(
        F.filter("b_words", lambda v: ((F.col("a") != F.col("b")) | (u["word"] < v["word"])) & _one_edit(u["word"], v["word"])), lambda v: F.struct(u.alias("u"), v.alias("v")))))
    listed = both.filter(F.col("a_words").isNotNull() & F.col("b_words").isNotNull()).select(F.explode(found).alias("p")).select("p.u", "p.v")
    pairs = listed.unionByName(_of_large(met, words, sizes, reduced, (letters, hashed), most))
    ends = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))
    return pairs.select(F.explode(ends).alias("e")).select(F.col("e.x.word").alias("word"), F.col("e.y.word").alias("other"), F.col("e.y.n").alias("other_n"))


def _of_large(met: DataFrame, words: DataFrame, sizes: DataFrame, reduced: Column, table: tuple[str, str], most: int) -> DataFrame:
    """Pairs of classes of which one is large, through the variants of the smaller one's words."""
    letters, hashed = table

    def generate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorten = str.maketrans(letters, hashed)
        for batch in batches:
            for word, n, own, targets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = set(targets)
                near = [x for x in neighbourhood(word, letters) if (x > word or x.translate(shorten) != own) and x.translate(shorten) in wanted and x != word]
                yield pa.RecordBatch.from_arrays([pa.array([word] * len(near), pa.string()), pa.array([n] * len(near), pa.int64()), pa.array(near, pa.string())], ["word", "n", "variant"])

    size = lambda x: sizes.select(F.col("reduced").alias(x), F.col("size").alias(f"{x}_size"))
    large = met.join(size("a").hint("merge"), "a").join(size("b").hint("merge"), "b").filter(F.greatest("a_size", "b_size") > most)
    lesser = F.col("a_size") <= F.col("b_size")
    targets = (
        large.select(F.when(lesser, F.col("a")).otherwise(F.col("b")).alias("reduced"), F.when(lesser, F.col("b")).otherwise(F.col("a")).alias("to"))
        .groupBy("reduced").agg(F.collect_set("to").alias("targets"))
    )  # fmt: skip  at most the one-edit neighbourhood of a spelling
    made = words.select("word", "n", reduced).join(targets.hint("merge"), "reduced").select("word", "n", "reduced", "targets").mapInArrow(generate, "word string, n bigint, variant string")
    held = words.select(F.col("word").alias("variant"), F.col("n").alias("variant_n")).hint("merge")
    return made.join(held, "variant").select(F.struct("word", "n").alias("u"), F.struct(F.col("variant").alias("word"), F.col("variant_n").alias("n")).alias("v"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: where following forms ends. Each step up multiplies the count, so chains are short and their steps double each time."""
    now = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = cut(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        if then.filter("moved").isEmpty():
            return then.drop("moved")
        now = cut(then.drop("moved"), "spelling-roots")
        discard(then)


def variant_groups(docs: DataFrame, slip: int | None = SLIP, symbols: int | None = None, most: int = CLASS) -> DataFrame:
    """One row for each word: ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    words = cut(vocabulary(docs, slip), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = near_pairs(words, symbols, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = cut(words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "best"), "spelling-near")
    fits = -F.col("best.less") >= RATIO * F.col("n")
    known = known.select("word", "n", "n_near", F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    roots = _roots(known.filter(F.col("form").isNotNull()))
    return known.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
