"""Language-model scores, tries of conversations and spelling variants against plain versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlore.llm import lm_scoring, prefix_trie, queries, spelling_groups

# 11 ----------------------------------------------------------------------------------------------


def plain_weights(cells, words: int) -> dict[int, list[float]]:
    found: dict[int, list[float]] = {}
    for b in {c[0] for c in cells}:
        lam = [1 / 3] * 3
        for _ in range(200):
            got = [0.0] * 3
            for _, w, *estimates in (c for c in cells if c[0] == b):
                parts = [x * y for x, y in zip(lam, (*estimates, 1 / (words + 1)), strict=True)]
                for k in range(3):
                    got[k] += w * parts[k] / sum(parts)
            lam = [max(x / sum(got), lm_scoring.LEAST_WEIGHT) for x in got]
            lam = [x / sum(lam) for x in lam]
        found[b] = lam
    return found


def plain_scores(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    power = lambda n: n.bit_length()
    seqs, one, two, gone_one, gone_two = [], collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for i, text in rows:
        s = ["\n", *(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))), "\n"]
        h = zlib.crc32(("" if i is None else str(i)).encode())
        seqs.append((i, h % 5 == 1, s))
        if h % 5 != 1:
            one.update(s[1:])
            two.update(zip(s, s[1:], strict=False))
            if h // 5 % 10 == 0:
                gone_one.update(s[1:])
                gone_two.update(zip(s, s[1:], strict=False))
    n, v, left = one.total(), len(one), one.total() - gone_one.total()
    kept = lambda x: one[x] - gone_one[x]
    cells = [(power(kept(a)), w, (two[a, b] - gone_two[a, b]) / max(kept(a), 1), kept(b) / max(left, 1)) for (a, b), w in gone_two.items()]
    lam, last = plain_weights(cells, v), [0.4, 0.5, 0.1]
    for b in range(64):
        if b in lam:
            last = lam[b] if b else last
        else:
            lam[b] = last if b else [0, 0.9, 0.1]
    out = []
    for i, held, s in seqs:
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s[1:])
        score = 0.0
        for a, b in zip(s, s[1:], strict=False):
            x, y, z = lam[power(one[a])]
            score += math.log10(x * two[a, b] / max(one[a], 1) + y * one[b] / n + z / (v + 1)) if n else 0
        out.append((i, held, len(s) - 1, sum(one[w] > 0 for w in s[1:]), n, base, score))
    return out


def same_scores(got, want) -> None:
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=2e-3, abs=1e-3), a[0]


COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def test_scores_of_the_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_lm_score(spark, small)
    assert tuple(got.columns) == COLUMNS
    got = got.collect()
    same_scores(got, plain_scores(docs))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)


@pytest.mark.parametrize("limits", [{"head": 3, "buckets": 5, "pair_share": 20}, {"head": 1, "buckets": 1, "pair_share": 0}])
def test_scores_alike_whatever_is_frequent(make, limits):
    """Ranks, buckets and the most frequent pairs decide where counts are found, not what they are."""
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["The", "the", "of", f"w{rng.randrange(40)}", f"x{rng.randrange(900)}", "É"]) for _ in range(rng.randrange(30)))) for k in range(150)]
    same_scores(lm_scoring.score(make([(i, t, "en", "a") for i, t in rows], 4), **limits).collect(), plain_scores(rows))


def test_scores_of_awkward_rows(spark, awkward, make):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = lm_scoring.score(awkward).collect()
    same_scores(got, plain_scores(rows))
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}  # null, empty and blank texts have their end
    assert len([r for r in got if r.doc_id == 5]) == 2  # repeated rows are scored each
    left_out = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5 == 1)
    assert tuple(lm_scoring.score(make([(left_out, "a b", "en", "a")])).first())[1:] == (True, 3, 0, 0, 0.0, 0.0)
    assert lm_scoring.score(awkward.filter("doc_id < 0")).count() == 0
    with pytest.raises(ValueError, match="18 bits"):
        lm_scoring.score(awkward, head=1 << 19)


def test_packed_numbers():
    for a in (np.arange(1000, dtype=np.int64), np.array([2**63 + 5], np.uint64), np.empty(0, np.float32), np.linspace(0, 1, 7)):
        assert (lm_scoring.expand(lm_scoring.squeeze(a), a.dtype.type) == a).all()


# 12 ----------------------------------------------------------------------------------------------


def plain_trie(rows: list[tuple], borrow: bool) -> list[tuple]:
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(t)] for c, t in convs.items()}
    whole = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.copysign(abs(c) % 100, c))
        whole[c] = turns.get(base, [])[:h] + t[h:] if borrow else t
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    saved, leaves = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not children[k]
    return sorted((
        m[0], len(k), members[k[:-1]][0] if k else -1, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(k)).encode()).hexdigest(),
    ) for k, m in members.items())


def made_conversations(seed: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for c in [*range(120), *range(-30, -1), 100_000_000_007]:
        kind = rng.randrange(5)
        said = ["a", "b"] if kind < 2 else ["a"] if kind == 2 else [rng.choice(["a", "b", "", None, "é𠮷"]) for _ in range(rng.randrange(1, 9))]
        rows += [(c, k, rng.choice(["user", None]) if kind == 4 else "user", x) for k, x in enumerate(said)]
    rows += [(5, None, "system", "first"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (None, 0, "user", "nobody's"), (7, 0, None, None)]
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def collected(df) -> list[tuple]:
    assert tuple(df.columns) == prefix_trie.RESULT
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


@pytest.mark.parametrize("ranges", [1, 7])
def test_trie_over_ranges(spark, ranges):
    rows = made_conversations(ranges)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("place", F.lit(2)).repartition(3)
    assert collected(prefix_trie.conversation_trie(df, ranges)) == plain_trie(rows, False)
    borrowed = prefix_trie.with_borrowed_heads(prefix_trie.digested(df))
    assert collected(prefix_trie.trie(prefix_trie.sequences(borrowed), ranges)) == plain_trie(rows, True)


def test_many_copies_and_a_long_conversation(spark):
    """Copies lie in several ranges; a long conversation has a node for each turn."""
    rows = [(c, k, "user", f"t{k}") for c in range(300) for k in range(2)] + [(900, k, "user", f"t{k}") for k in range(3000)] + [(901, k, "user", f"t{k}" if k < 2500 else "x") for k in range(2600)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(prefix_trie.conversation_trie(df, 7)) == plain_trie(rows, False)


def test_no_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).count() == 0
    only = prefix_trie.trie(prefix_trie.sequences(prefix_trie.with_borrowed_heads(prefix_trie.digested(spark.createDataFrame([(107, 0, "user", "a")], SCHEMA)))))
    assert zlib.crc32(b"107") % 6 > 0 and collected(only) == [(107, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"107").hexdigest())]  # turnless, a member of the root


def test_pieces_are_hashed_in_order(spark):
    rows = [(c, 0, "user", "same") for c in range(1000)]
    want = hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), 9).filter("depth = 1").collect()
    assert [(r.n_convs, r.ends_sha256) for r in found] == [(1000, want)]


# 13 ----------------------------------------------------------------------------------------------


def plain_groups(rows: list[tuple], slip: int | None = 31) -> list[tuple]:
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    gaps = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return a in gaps(b) if len(a) + 1 == len(b) else b in gaps(a) if len(b) + 1 == len(a) else False

    form, n_near = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, n, n_near[w], words[form[w]] if form[w] else -1))
    return sorted(out)


def made_words(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    stems = ["colourful", "télévision", "aaaaaaa", "ÿÿÿÿÿÿÿÿ", "Straßenbahn", "mississippi"]
    chain = ["abcdefgh"] * 480 + ["abcdefgi"] * 40 + ["abcdefxi"] * 3
    texts = []
    for k in range(60):
        words = []
        for _ in range(25):
            w = rng.choice(stems)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abéÀ") + w[at + 1 :]])
            words += [w] * rng.choice([1, 1, 2, 12])
        texts.append((k, " ".join(words + chain[k::60])))
    return [*texts, (None, "nobody's colourful colourful"), (90, None), (91, ""), (1, texts[1][1])]


@pytest.mark.parametrize("how", [{}, {"symbols": 3, "most": 1}, {"symbols": 90, "slip": None}])
def test_variants_by_brute_force(make, how):
    rows = made_words(3)
    found = spelling_groups.variant_groups(make([(i, t, "en", "a") for i, t in rows]), **how)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or -1) for r in found.collect())
    assert got == plain_groups(rows, how.get("slip", 31))
    if "slip" in how:
        assert ("abcdefxi", "abcdefgi", "abcdefgh") in {r[:3] for r in got}  # a form that has a form


def test_neighbourhoods():
    assert spelling_groups.neighbourhood("ab", "ab") == {"ab", "bb", "aa", "a", "b", "aab", "bab", "abb", "aba"}
    letters, hashed = spelling_groups.alphabet(5)
    assert len(letters) == len(set(letters)) == len(hashed) == 90 and len(set(hashed)) == 5
    assert [spelling_groups.symbols_for(n) for n in (0, 1000, 10**6, 10**9)] == [4, 4, 4, 7]


def test_awkward_words(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or -1) for r in spelling_groups.variant_groups(awkward).collect())
    assert got == plain_groups(rows)
    assert spelling_groups.variant_groups(awkward.filter("doc_id < 0")).count() == 0
