"""Secret scan: fixed patterns, and guess costs of values that stand where credentials do.

The fixed patterns find assignments, access keys and hexadecimal runs. The
method adds values in a credential context whose guess cost is high: a
dynamic program splits the value into dictionary words, dates, repeats,
keyboard walks, sequences and brute-force spans so that the product of their
guesses is least; a value that takes many guesses even so is a secret, one
that words and dates explain is not. Words are ranked: frequent parts of
passwords come first, then the whole words of a public tokenizer's
vocabulary, whose order is that of their frequency.

Texts without any trigger are told apart inside the JVM and never reach
Python. Defined results: a null text counts as empty and has no spans; spans
are code points, ends exclusive, ordered by start, then kind as listed in
``KINDS``; repeated rows are scanned each on its own; an empty table gives
an empty result; other columns are passed on.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlore.plans.shared import bound_batches

KINDS = ("assign", "access", "hex", "guess")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Where a credential is named, and a value of six or more characters beside it.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pass|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|auth)["']?\x20*(?::=|=>|[:=])\x20*(["']?)([^\x20\x09-\x0D"'<>,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)
#: What a text must hold for any span, in the JVM's syntax.
TRIGGER = r"AKIA[A-Z0-9]|[0-9a-f]{16}|(?i:(?:pass|pwd|secret|token|api_?key|access_?key|private_?key|credential|auth)[a-z]*)[\"']?\x20*[:=]"
#: Values that take at least ten to the power of this many guesses are secrets: from there on guessing offline is hard.
LEAST_LOG10_GUESSES = 10.0
#: Shortest and longest word of the dictionary.
SHORTEST, LONGEST = 3, 20

#: Frequent parts of passwords, most frequent first; fixed values.
WORDS = (
    "password", "admin", "welcome", "letmein", "login", "master", "dragon", "monkey", "shadow", "sunshine", "princess",
    "football", "baseball", "superman", "batman", "iloveyou", "trustno", "hello", "freedom", "whatever", "secret",
    "token", "test", "testing", "example", "sample", "demo", "dummy", "changeme", "change", "me", "default", "guest",
    "root", "user", "username", "your", "my", "here", "key", "api", "access", "placeholder", "value", "string", "none",
    "null", "true", "false", "undefined", "xxx", "foo", "bar", "baz", "abc", "the", "and", "for", "with", "this",
    "that", "summer", "winter", "spring", "autumn", "january", "february", "march", "april", "june", "july", "august",
    "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday",
    "sunday", "love", "star", "blue", "red", "green", "black", "white", "silver", "gold", "king", "queen", "angel",
    "tiger", "eagle", "house", "home", "work", "office", "company", "server", "database", "data", "cloud", "config",
    "env", "prod", "production", "dev", "development", "staging", "local", "host", "localhost", "name", "id", "code",
    "pass", "word", "file", "path", "service", "client", "public", "private", "auth", "bearer", "basic", "session",
)
LEET = str.maketrans("0134578@$!", "oleastbasi")
#: Rows of a keyboard, each key beside the next; fixed values.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: Keys that lie side by side or, in the row below, under one another.
NEAR = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
NEAR |= {(a, b) for up, down in zip(ROWS, ROWS[1:], strict=False) for k, a in enumerate(up.lstrip("`")) for b in down[max(0, k - 1) : k + 1]}
NEAR |= {(b, a) for a, b in NEAR}
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d")
COSTS = {"digit": math.log10(10), "letter": math.log10(26), "both": math.log10(52), "other": math.log10(33)}
#: A new segment: where it ends is one more thing to guess.
SEGMENT = math.log10(2)


@lru_cache(maxsize=4)
def ranks(vocabulary: str) -> dict[str, int]:
    """Rank of each word: :data:`WORDS`, then the whole words of a vocabulary whose ids ascend as frequency falls."""
    with open(vocabulary, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    whole = (w.removesuffix("</w>") for w in sorted(ids, key=ids.get) if w.endswith("</w>"))
    named = [*WORDS, *(w for w in whole if SHORTEST <= len(w) <= LONGEST and w.isalpha())]
    return {w: k + 1 for k, w in enumerate(dict.fromkeys(named))}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letter_cost(c: str, both: bool = False) -> float:
    """Guesses for one character; ``both``: among letters of either case."""
    letter = COSTS["both" if both else "letter"]
    return COSTS["digit"] if c.isdigit() else letter if c.isalpha() and c.isascii() else COSTS["other"]


def both_cases(value: str) -> bool:
    return value != value.lower() and value != value.upper()


def _runs(value: str, linked) -> list[tuple[int, int]]:
    """Maximal stretches in which every two neighbours are linked."""
    found, start = [], 0
    for k in range(1, len(value) + 1):
        if k == len(value) or not linked(value[k - 1], value[k]):
            if k - start > 1:
                found.append((start, k))
            start = k
    return found


def segments(value: str, rank_of: dict[str, int]) -> list[tuple[int, int, float]]:
    """(start, end, log10 of guesses) of everything in a value that is easier than its characters; as many as it is long, give or take a factor."""
    low, out = value.lower(), []
    if len(low) != len(value):  # a letter whose lower case is two
        low = value
    plain = low.translate(LEET)
    for s in range(len(value)):
        for e in range(s + 2, min(len(value), s + LONGEST) + 1):
            for text, more in ((low, 0.0), (plain, math.log10(4))):
                if rank := rank_of.get(text[s:e]):
                    case = 0.0 if value[s:e] == text[s:e] or more else math.log10(2)
                    out.append((s, e, math.log10(rank + 1) + more + case))
                    break
        if m := DATE.match(value, s):
            out.append((s, m.end(), math.log10(120) if m.end() - s == 4 else math.log10(365 * 120)))
        if value[s] in "-_. ":  # what parts words is guessed with them
            out.append((s, s + 1, math.log10(4)))
    for s, e in _runs(low, lambda a, b: a == b):
        out.append((s, e, _letter_cost(low[s]) + math.log10(e - s)))
    for size in range(2, 17):  # a unit that is repeated
        k = 0
        while k + 2 * size <= len(value):
            e = k + size
            while value[e : e + size] == value[k : k + size]:
                e += size
            if e > k + size:
                out.append((k, e, sum(map(_letter_cost, value[k : k + size])) + math.log10((e - k) / size)))
                k = e - size + 1
            else:
                k += 1
    for s, e in _runs(low, lambda a, b: (a, b) in NEAR):
        if e - s >= 3:
            out.append((s, e, math.log10(47) + (e - s) * math.log10(1.6)))
    for step in (1, -1):
        for s, e in _runs(low, lambda a, b, step=step: ord(b) - ord(a) == step and a.isalnum()):
            if e - s >= 3:
                out.append((s, e, _letter_cost(low[s]) + math.log10(2 * (e - s))))
    return out


def log10_guesses(value: str, vocabulary: str | None = None) -> float:
    """Least cost of splitting a value into segments and brute-force spans, in time linear in its length."""
    both, rank_of = both_cases(value), ranks(vocabulary or default_vocabulary())
    ends: dict[int, list[tuple[int, float]]] = {}
    for s, e, cost in segments(value, rank_of):
        ends.setdefault(e, []).append((s, cost))
    # least cost up to each place, when a segment ends there and when a brute-force span does
    done, brute = [0.0], [math.inf]
    for e in range(1, len(value) + 1):
        c = _letter_cost(value[e - 1], both)
        brute.append(min(brute[e - 1], done[e - 1] + SEGMENT) + c)
        best = brute[e]
        for s, cost in ends.get(e, ()):
            best = min(best, done[s] + SEGMENT + cost)
        done.append(best)
    return done[-1]


def spans(text: str, least: float = LEAST_LOG10_GUESSES, vocabulary: str | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in a text."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = sorted(x[1:] for x in found)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for m in CONTEXT.finditer(text):
        s, e = m.span(2)
        before = bisect_left(starts, e)  # spans that start before the value ends; one that reaches into it overlaps
        if (not before or reach[before - 1] <= s) and log10_guesses(m[2], vocabulary) >= least:
            found.append(("guess", s, e))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``secrets``, which replaces a column of that name: array of (kind, start, end). ``vocabulary``: file of ranked words, there on every executor; None: the public one."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [{"kind": k, "start": s, "end": e} for k, s, e in spans(t, vocabulary=vocabulary)] for t in texts])

    triggered = F.when(F.col("text").rlike(TRIGGER), F.col("text"))
    return docs.withColumn("secrets", find(triggered))


def joined(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(text: Column, found: Column) -> Column:
    """A text with its secrets replaced by their kind."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), x["start"] - acc["at"]).cast("int"))
        new = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(new.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    return F.aggregate(found, state, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
