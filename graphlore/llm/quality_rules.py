"""Quality rules with adaptive thresholds.

Each document gets word and line features, computed inside the JVM. A
mergeable quantile sketch (KLL) of each feature is built for every language
and source; the sketches of a language's sources are merged into one of the
language. A feature's upper limit is a fence above the quartiles of the
document's own (language, source) group, tightened by the fence of the whole
language, so a source that is mostly junk can't set its own limit. Documents
are joined with the limits and those beyond any of them are rejected.

Defined results: null and blank texts have no words, so ``base_failed``
holds and they are rejected; null languages and sources are groups of their
own; repeated rows are judged alike, each on its own; an empty table gives
an empty result; other columns, whatever their names, are kept by
:func:`quality_filter` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlore.functions.columns import WORD, let, words_of
from graphlore.plans.shared import cut

#: Sketch size: groups of up to about this many documents are exact.
SKETCH_K = 4096
#: A limit is the third quartile plus this many times the interquartile range, and at least the slack of the feature.
FENCE = 6.0
#: Feature: room above the fence, in its own unit. Symbols a word; code points a word; share of lines that repeat.
FEATURES = {"symbol_rate": 0.2, "word_length": 6.0, "dup_line_rate": 0.5}
#: Up to this many (language, source) limits are sent to every executor; more are joined by a salted shuffle.
BROADCAST_GROUPS = 20_000
SALTS = 64


def repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in ``words``, first occurrences included."""
    n = F.size(words)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def union(p: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
            at = F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1))
            places = F.array_sort(F.transform(at, lambda x: x["i"]))
            reach = lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(s, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b)
            return let(places, reach)

        # most texts repeat nothing; they skip the sort
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, union))

    return F.when(n < 6, F.lit(0)).otherwise(let(words, lambda w: let(hashes(w), count))).cast("bigint")


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, read from whole texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
    df = df.withColumn("_words", words_of(F.col(text))).withColumn("_lines", lines)
    made = {
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_repeat_words": repeated_words(F.col("_words")),
    }
    df = df.withColumns(made).drop("_words", "_lines")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _rates(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.withColumns({
        "symbol_rate": F.col("n_symbols") / words,
        "word_length": F.col("word_chars") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
    })


def adaptive_limits(features: DataFrame) -> DataFrame:
    """lang, source and the limit of each feature. Partial sketches are built before the shuffle."""
    rated = _rates(features.filter(~F.col("base_failed")))
    sketches = rated.groupBy("lang", "source").agg(*[F.kll_sketch_agg_double(f, F.lit(SKETCH_K)).alias(f) for f in FEATURES])
    merged = sketches.groupBy("lang").agg(*[F.kll_merge_agg_double(f, F.lit(SKETCH_K)).alias(f"lang_{f}") for f in FEATURES])

    def limit(sketch: str, slack: float) -> Column:
        q = lambda p: F.kll_sketch_get_quantile_double(sketch, F.lit(p))
        return q(0.75) + F.lit(FENCE) * (q(0.75) - q(0.25)) + F.lit(slack)

    own = sketches.select("lang", "source", *[limit(f, s).alias(f"max_{f}") for f, s in FEATURES.items()])
    whole = merged.select(F.col("lang").alias("_lang"), *[limit(f"lang_{f}", s).alias(f"all_{f}") for f, s in FEATURES.items()])
    both = own.join(whole, own["lang"].eqNullSafe(whole["_lang"]))
    return both.select("lang", "source", *[F.least(f"max_{f}", f"all_{f}").alias(f"max_{f}") for f in FEATURES])


def judged(features: DataFrame, limits: DataFrame) -> DataFrame:
    """``features`` with ``kept``: joined with the limits of their group."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    few = limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    same = features["lang"].eqNullSafe(limits["_lang"]) & features["source"].eqNullSafe(limits["_source"])
    if few:
        joined = features.join(F.broadcast(limits), same, "left")
    else:  # a group's documents are spread over salts, its limit is repeated for each
        salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = features.withColumn("_own_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = spread.join(salted, same & (spread["_own_salt"] == salted["_salt"]), "left").drop("_own_salt", "_salt")
    within = F.lit(True)
    rated = _rates(joined)
    for f in FEATURES:
        within = within & F.coalesce(F.col(f) <= F.col(f"max_{f}"), F.lit(True))
    return rated.withColumn("kept", ~F.col("base_failed") & within)


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, ``base_failed`` and ``kept`` of every document. Counts are taken once and written, without texts."""
    slim = text_features(docs.select("doc_id", "lang", "source", "text")).drop("text")
    features = cut(slim, "quality-features")
    limits = cut(adaptive_limits(features), "quality-limits")
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(features, limits).select(*out)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    Texts are written once beside their counts, so that they are neither
    counted twice nor shuffled.
    """
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), "doc_id", "lang", "source", "text")
    features = cut(text_features(packed).drop("text"), "quality-documents")
    limits = cut(adaptive_limits(features), "quality-limits")
    return judged(features, limits).filter("kept").select("_row.*")
