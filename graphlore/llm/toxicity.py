"""Toxicity by weak supervision.

Lexicons of word beginnings, word endings and whole words are mined from the
labelled rows. No entry of the lexicons of beginnings and words holds another
one, and each lexicon is parted by a hash of its entries, so no voter's
entries are those of another. With patterns of the text (exclamation,
shouting) and of its structure (hits that repeat, that lie in both halves,
that are dense) they make sixteen voters. A generative label model takes how
often each of the 2^16 possible vote patterns occurs, over all documents, and
estimates by expectation maximisation the rates of every voter in toxic and
in other texts and the correlations: voters that depend on each other beyond
the class are linked in a forest, and each linked voter's rates are
parameters for either vote of the one it hangs on. The model's posteriors
label a bounded sample without looking at gold labels, and a linear
classifier trained on them, over counts of the text that also take in entries
too weak to vote, scores every document.

Labels are used to mine the lexicons and for the share of toxic texts only,
over all labelled rows outside the held-out fold. Language, source, labels
and identifiers are never inputs of a score.

Defined results: null and empty texts are scored like any text without hits;
without a toxic label the lexicons are empty and all scores are low; repeated
rows get equal scores; a null doc_id is not held out; an empty table gives an
empty result; other columns, whatever they are called, are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlore.plans.shared import bound_batches, cut

#: Most rows that the classifier is fitted on.
FIT_ROWS = 20_000
#: Lexicons: name, kind and lengths of entries, and into how many voters' parts they are dealt.
BEGINNINGS, LONG, ENDING, WORD = (3, 4), (5, 6, 8), 4, 0
GROUPS = (("short", 3), ("long", 3), ("word", 2), ("ending", 2))
#: An entry is in this share of toxic texts at least, and in three: so the lexicons are bounded whatever the corpus.
LEAST_SHARE, LEAST_TEXTS = 0.004, 3.0
SMOOTH = 0.5
#: An entry that votes is at least this many times as likely in a toxic text as in another; a weak one this many times.
LEAST_ODDS, WEAK_ODDS = 24.0, 4.0
#: Voters are linked from this conditional mutual information (nats) on.
LINKED = 0.002


@dataclass(frozen=True)
class Entry:
    """A part of a word, where it stands in it, the log of its odds, and its voter; voter -1: too weak to vote."""

    text: str
    kind: str
    weight: float
    voter: int

    def pattern(self) -> str:
        return {"short": f" {self.text}", "long": f" {self.text}", "word": f" {self.text} ", "ending": f"{self.text} "}[self.kind]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def bounded_sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """``most`` rows or all, the same ones however rows are dealt.

    A share is kept by hash first, so that what meets in one place is
    about ``most`` rows and not that many of every partition.
    """
    n = rows.count()
    span = 1 << 30
    share = span if n <= most else int(span * min(1.0, 1.2 * most / n))
    place = F.xxhash64("doc_id", F.lit(seed))
    kept = rows.filter(F.pmod(place, F.lit(span)) < share)
    return kept.orderBy(place, *[F.col(c) for c in rows.columns if c != "x"]).limit(most)


def _letters(text: Column) -> Column:
    """Lower-case words parted by single spaces, one at each end."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "), F.lit(" "))


def _parts(words: Column) -> Column:
    """The distinct entries (kind, text) that a text's words give to the lexicons."""
    named = lambda kind, x: F.transform(x, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("entry")))
    longer = lambda k: F.filter(words, lambda w: F.length(w) >= k)
    starts = lambda k: F.array_distinct(F.transform(longer(k), lambda w: F.substring(w, 1, k)))
    ends = F.array_distinct(F.transform(longer(ENDING), lambda w: F.substring(w, -ENDING, ENDING)))
    return F.concat(*[named("short", starts(k)) for k in BEGINNINGS], *[named("long", starts(k)) for k in LONG], named("word", longer(2)), named("ending", ends))


def minimal(found: list[tuple[str, str, float, bool]]) -> list[Entry]:
    """Entries (kind, text, weight, whether it votes), without beginnings and words that begin with another one that votes."""
    strong = {text for kind, text, _, votes in found if votes and kind in ("short", "long")}
    first = {}
    for at, (kind, groups) in enumerate(GROUPS):
        first[kind] = (sum(n for _, n in GROUPS[:at]), groups)
    out = []
    for kind, text, weight, votes in found:
        shorter = (text[:k] for k in (*BEGINNINGS, *LONG) if k < len(text) or (kind == "word" and k == len(text)))
        if kind != "ending" and any(x in strong for x in shorter):
            continue
        start, groups = first[kind]
        part = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little") % groups
        out.append(Entry(text, kind, weight, start + part if votes else -1))
    return out


def mine_lexicons(labelled: DataFrame) -> list[Entry]:
    """Entries that mark toxic texts. ``labelled``: text, toxic. Counted over all rows; what is collected is bounded by :data:`LEAST_SHARE`."""
    words = F.array_distinct(F.split(F.trim(_letters(F.col("text"))), " "))
    labelled = cut(labelled.select(words.alias("words"), (F.col("toxic") == 1).cast("int").alias("toxic")), "toxicity-labelled")
    n, toxic = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        return []
    # what is in too few toxic texts is out before other texts are counted
    marked = labelled.filter("toxic = 1").select(F.explode(_parts(F.col("words"))).alias("x")).groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("t"))
    marked = cut(marked.filter(F.col("t") >= max(LEAST_TEXTS, LEAST_SHARE * toxic)).select("x.kind", "x.entry", "t"), "toxicity-marked")
    other = labelled.filter("toxic = 0").select(F.explode(_parts(F.col("words"))).alias("x")).select("x.kind", "x.entry")
    other = other.groupBy("kind", "entry").agg(F.count(F.lit(1)).cast("double").alias("o"))
    counts = marked.join(other, ["kind", "entry"], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    odds = ((F.col("t") + SMOOTH) / (toxic + 2 * SMOOTH)) / ((F.col("o") + SMOOTH) / (n - toxic + 2 * SMOOTH))
    kept = counts.withColumn("odds", odds).filter(F.col("odds") >= WEAK_ODDS).orderBy("kind", "entry")
    return minimal([(r["kind"], r["entry"], float(np.log(r["odds"])), r["odds"] >= LEAST_ODDS) for r in kept.collect()])


LEXICON_VOTERS = [f"{kind}_{k}" for kind, n in GROUPS for k in range(n)]
#: What :func:`text_hits` gives of a text, in order.
HITS = [f"hits_{v}" for v in LEXICON_VOTERS] + ["weight", "weak", "entries", "most", "halves"]
FEATURES = [*HITS, "words", "exclaims", "shouts"]
_automata: dict[bytes, object] = {}


def _automaton(lexicon: list[Entry]):
    """Built once for each Python worker and lexicon."""
    key = hashlib.blake2b(repr(lexicon).encode(), digest_size=16).digest()
    if key not in _automata:
        _automata.clear()
        find = ahocorasick.Automaton()
        for k, e in enumerate(lexicon):
            find.add_word(e.pattern(), (k, e.voter, e.weight))
        find.make_automaton()
        _automata[key] = find
    return _automata[key]


def count_hits(text: str, find) -> list[float]:
    """The counts of :data:`HITS` in lower-case words parted by single spaces, one at each end."""
    n = len(LEXICON_VOTERS)
    row, own, middle, first, second = [0.0] * len(HITS), {}, len(text) // 2, 0, 0
    for at, (k, voter, weight) in find.iter(text):
        if voter < 0:
            row[n + 1] += weight
            continue
        row[voter] += 1
        row[n] += weight
        own[k] = own.get(k, 0) + 1
        first, second = (first + 1, second) if at < middle else (first, second + 1)
    row[n + 2], row[n + 3], row[n + 4] = float(len(own)), float(max(own.values(), default=0)), float(min(first, second))
    return row


def text_hits(docs: DataFrame, lexicon: list[Entry]) -> DataFrame:
    """doc_id and the counts of :data:`FEATURES` of every whole text."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def hits(texts: pa.Array) -> pa.Array:
        if not lexicon:
            return pa.array([[0.0] * len(HITS)] * len(texts), pa.list_(pa.float64()))
        find = _automaton(lexicon)
        return pa.array([count_hits(t, find) for t in texts.to_pylist()], pa.list_(pa.float64()))

    text = F.coalesce("text", F.lit(""))
    made = docs.select("doc_id", hits(_letters(F.col("text"))).alias("h"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.regexp_count(text, F.lit("!")).alias("exclaims"), F.regexp_count(text, F.lit(r"\b[A-Z]{3,}\b")).alias("shouts"))
    return made.select("doc_id", *[F.col("h")[k].alias(c) for k, c in enumerate(HITS)], *[F.col(c).cast("double").alias(c) for c in FEATURES[len(HITS) :]])


def _a_word(name: str) -> Column:
    return F.col(name) / F.greatest(F.col("words"), F.lit(1.0))


def voters() -> dict[str, Column]:
    """Name and condition of each voter: it votes 1 where that holds, else 0."""
    c = F.col
    every = sum((c(f"hits_{v}") for v in LEXICON_VOTERS), F.lit(0.0))
    out = {v: c(f"hits_{v}") >= 1 for v in LEXICON_VOTERS}
    out |= {"repeats": c("most") >= 2, "halves": c("halves") >= 1, "dense": every >= 0.02 * F.greatest(c("words"), F.lit(1.0)), "several": c("entries") >= 3}
    return out | {"exclaims": _a_word("exclaims") >= 0.05, "shouts": _a_word("shouts") >= 0.1}


@dataclass(frozen=True)
class LabelModel:
    """Share of toxic texts, and each voter's chance to vote 1 by class (0, 1) and by the vote (0, 1) of the voter it is linked to (-1: none)."""

    names: list[str]
    prior: float
    linked: list[int]
    rates: np.ndarray

    def logit(self, votes: dict[str, Column]) -> Column:
        out = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for j, name in enumerate(self.names):
            yes, no = np.log(self.rates[j, 1] / self.rates[j, 0]), np.log((1 - self.rates[j, 1]) / (1 - self.rates[j, 0]))
            given = [F.when(votes[name], float(yes[v])).otherwise(float(no[v])) for v in (0, 1)]
            up = self.linked[j]
            out = out + (given[0] if up < 0 else F.when(votes[self.names[up]], given[1]).otherwise(given[0]))
        return out

    def log_chances(self, patterns: np.ndarray) -> np.ndarray:
        """Log of the chance of each pattern together with either class, a row for each pattern."""
        out = np.tile(np.log([1 - self.prior, self.prior]), (len(patterns), 1))
        for j, up in enumerate(self.linked):
            given = patterns[:, up] if up >= 0 else np.zeros(len(patterns), dtype=int)
            for y in (0, 1):
                p = self.rates[j, y][given]
                out[:, y] += np.log(np.where(patterns[:, j] == 1, p, 1 - p))
        return out

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        both = self.log_chances(patterns)
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))


def _rates(patterns: np.ndarray, counts: np.ndarray, q: np.ndarray, linked: list[int]) -> np.ndarray:
    """Smoothed chances to vote 1, by voter, class and the linked voter's vote."""
    out = np.zeros((len(linked), 2, 2))
    for y, w in ((0, counts * (1 - q)), (1, counts * q)):
        for j, up in enumerate(linked):
            alone = (w @ patterns[:, j] + 0.1) / (w.sum() + 0.2)
            for v in (0, 1):
                own = w if up < 0 else w * (patterns[:, up] == v)
                # rates given a vote that hardly occurs are drawn to the voter's own rate
                out[j, y, v] = (own @ patterns[:, j] + 5 * alone) / (own.sum() + 5)
    return np.clip(out, 1e-6, 1 - 1e-6)


def _forest(patterns: np.ndarray, counts: np.ndarray, q: np.ndarray) -> list[int]:
    """For each voter the one it is linked to: a greatest spanning forest by conditional mutual information."""
    m, total = patterns.shape[1], counts.sum()
    worth = np.zeros((m, m))
    for y, w in ((0, counts * (1 - q)), (1, counts * q)):
        size = max(w.sum(), 1e-9)
        for i in range(m):
            for j in range(i):
                for a in (0, 1):
                    for b in (0, 1):
                        both = (w @ ((patterns[:, i] == a) & (patterns[:, j] == b))) / size
                        apart = ((w @ (patterns[:, i] == a)) / size) * ((w @ (patterns[:, j] == b)) / size)
                        if both > 1e-12:
                            worth[i, j] += size / total * both * np.log(both / apart)
    tree, linked = list(range(m)), {j: [] for j in range(m)}
    for i, j in sorted(((i, j) for i in range(m) for j in range(i) if worth[i, j] >= LINKED), key=lambda x: -worth[x]):
        if tree[i] != tree[j]:
            old = tree[i]
            tree = [tree[j] if t == old else t for t in tree]
            linked[i].append(j), linked[j].append(i)
    up, seen = [-1] * m, set()
    for root in range(m):
        todo = [root] if root not in seen else []
        seen |= {root}
        while todo:
            k = todo.pop()
            for x in linked[k]:
                if x not in seen:
                    seen.add(x)
                    up[x] = k
                    todo.append(x)
    return up


def fit_label_model(names: list[str], patterns: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60) -> LabelModel:
    """The model by expectation maximisation over vote patterns (0 or 1, a column for each voter) and how often each occurs."""
    m = len(names)
    if not len(patterns):
        return LabelModel(names, prior, [-1] * m, np.full((m, 2, 2), 0.5))
    counts = counts.astype(float)
    # to begin with a text is the likelier toxic the more voters say so
    q = np.clip((patterns.sum(1) - 0.5) / 4, 0.001, 0.98)
    linked = [-1] * m
    for stage in range(2):
        for _ in range(rounds):
            model = LabelModel(names, prior, linked, _rates(patterns, counts, q, linked))
            q = model.posterior(patterns)
        if stage == 0:
            linked = _forest(patterns, counts, q)
    return model


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; x in standard units."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = docs.select("doc_id", "text")
    labels = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic").filter("toxic is not null")
    # a merge join whatever the sizes: labels grow with the corpus
    lexicon = mine_lexicons(docs.join(labels.hint("merge"), "doc_id").select("text", "toxic"))
    prior = labels.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    prior = min(max(prior, 0.01), 0.5)
    features = cut(text_hits(docs, lexicon), "toxicity-features")

    votes = voters()
    names = list(votes)
    pattern = sum((F.when(votes[v], 1 << k).otherwise(0) for k, v in enumerate(names)), F.lit(0))
    # at most 2^16 rows, however many documents there are
    seen = features.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    patterns = np.array([[r["pattern"] >> k & 1 for k in range(len(names))] for r in seen], dtype=int).reshape(-1, len(names))
    model = fit_label_model(names, patterns, np.array([r["n"] for r in seen]), prior)

    inputs = [F.log1p(F.col(c)) for c in HITS] + [F.log1p(100 * _a_word(c)) for c in ("weight", "weak")] + [_a_word(c) for c in ("exclaims", "shouts")]
    posterior = 1 / (1 + F.exp(-model.logit(votes)))
    fit = features.filter(~held_out(F.col("doc_id"))).select("doc_id", F.array(*inputs).alias("x"), posterior.alias("y"))
    fit = bounded_sample(fit, FIT_ROWS, 1).collect()
    if not fit or not lexicon:
        weights, base, scale = np.zeros(len(inputs)), float(np.log(prior / (1 - prior)) if not lexicon and prior < 0.5 else -1.0), np.ones(len(inputs))
    else:
        x, y = np.array([r["x"] for r in fit]), np.array([r["y"] for r in fit])
        scale = np.maximum(x.std(0), 1e-6)
        weights, base = fit_linear(x / scale, y)
    line = F.lit(base)
    for k, c in enumerate(inputs):
        line = line + F.lit(float(weights[k] / scale[k])) * c
    value = 1 / (1 + F.exp(-line))
    return features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
