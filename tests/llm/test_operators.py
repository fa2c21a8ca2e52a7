"""Each operator against a plain version, an exact round trip or held-out accuracy."""

from __future__ import annotations

import json
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlore.llm import chat_format, exact_dedup, license_scan, mixing, near_join, quality_rules, queries, secret_scan, sentencepiece_codec, suffix_dedup, suffix_groups, toxicity
from tests.llm import brute
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, small):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, small)


def documents(spark, small) -> dict[int, str]:
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


# 1 -----------------------------------------------------------------------------------------------

LAYOUTS = [
    {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    {"chat": {"turns": [{"speaker": "user", "utterance": "q"}, {"speaker": "bot", "utterance": "a"}]}},
    {"instruction": "q", "output": "a"}, {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"},
]


def test_layouts_become_the_same_turns(spark):
    rows = [(k, json.dumps(x)) for k, x in enumerate(LAYOUTS)] + [(90, json.dumps({"instruction": "q", "input": "more", "output": "a"})), (91, '{"other": 1}'), (92, "no json")]
    got = {r.k: r for r in chat_format.turns_from_json(spark.createDataFrame(rows, "k int, raw string"), "k", "raw").collect()}
    for k in range(len(LAYOUTS)):
        assert [(t.role, t.text) for t in got[k].turns] == [("user", "q"), ("assistant", "a")], LAYOUTS[k]
    assert got[90].turns[0].text == "q\n\nmore"
    assert got[91].layout == got[92].layout == "unknown" and got[91].turns is None
    assert len({chat_format.fingerprint(m.paths()) for m in chat_format.MAPPINGS}) == len(chat_format.MAPPINGS)
    for k, x in enumerate(LAYOUTS):
        table = spark.read.json(spark.sparkContext.parallelize([json.dumps(x | {"k": k})]))
        assert [(t.role, t.text) for t in chat_format.canonical_turns(table, "k").first().turns] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat_format.canonical_turns(spark.range(1).withColumn("k", F.lit(1)), "k")


MIXED = [  # value, layout, turns
    ({"prompt": None, "completion": "a"}, "prompt_completion", [("user", ""), ("assistant", "a")]),
    ({"messages": []}, "messages", []), ({"messages": None, "lang": "en"}, "messages", []),
    ({"messages": [{"role": "user", "content": None, "id": 1}, {"role": "gpt", "content": "a", "name": {"role": 3}}]}, "messages", [("user", ""), ("assistant", "a")]),
    ({"messages": [{"role": "user"}, "text", {"role": None, "content": "a"}]}, "messages", [("user", ""), ("", ""), ("", "a")]),
    ({"messages": [{"role": "user", "content": "q"}], "prompt": "p", "completion": "c"}, "messages", [("user", "q")]),
    ({"prompt": "q", "completion": "a", "response": "b", "question": "no answer"}, "prompt_completion", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "completion": "a", "system": ""}, "system_prompt", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "completion": "a", "system": "s", "meta": {"prompt": 1}}, "system_prompt", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"instruction": "q", "input": None, "output": 7, "turn": 1, "role": "x", "text": "y"}, "instruction_input", [("user", "q"), ("assistant", "7")]),
    ({"prompt": {"a": 1}, "completion": "a"}, "unknown", None), ({"prompt": "q"}, "unknown", None), ([], "unknown", None), (None, "unknown", None),
]


def test_mixed_layouts_find_their_mapping_by_fingerprint(spark):
    rows = [(k, json.dumps(x)) for k, (x, _, _) in enumerate(MIXED)] + [(80, None), (81, "")]
    got = {r.k: r for r in chat_format.turns_from_json(spark.createDataFrame(rows, "k int, raw string").withColumn("layout", F.lit("clash")).withColumn("_print", F.lit(1)), "k", "raw").collect()}
    for k, (x, layout, turns) in enumerate(MIXED):
        assert got[k].layout == layout, x
        assert (got[k].turns if turns is None else [(t.role, t.text) for t in got[k].turns]) == turns, x
    assert got[80].layout == got[81].layout == "unknown"
    # a registered set of paths and only such a one is found, by its digest
    known = chat_format.registry()
    for k, m in enumerate(chat_format.MAPPINGS):
        assert known[chat_format.fingerprint(m.paths())] == k
        schema = T.StructType([T.StructField(p.partition(":")[0], T.IntegerType() if p.endswith(":int") else T.StringType()) for p in [*m.paths(), "id:int", "other:string"] if "[]" not in p and "." not in p])
        if not m.items:
            assert set(chat_format.select_mapping(schema).paths()) <= set(chat_format.field_paths(schema))
    assert chat_format.fingerprint([]) not in known


def test_chat_round_trip(spark):
    texts = ["", "&lt;", "a <turn assistant>\nb</turn>\n", "\\### Assistant: </turn> ok", "&amp;amp; > <", "😀</turn>\n</turn>\n"]
    rows = [(k, n, random.Random(k + n).choice(["user", "assistant", "a>\n<b"]), t) for k in range(3) for n, t in enumerate(texts)]
    done = chat_format.format_chat(chat_format.canonical_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), "conv_id"))
    for r in done.withColumns({"read": chat_format.parse_chat(F.col("formatted")), "loss": chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))}).collect():
        want = [(role, t) for k, _, role, t in rows if k == r.conv_id]
        assert [(t.role, t.text) for t in r.read] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")


# 2 -----------------------------------------------------------------------------------------------

def highest_quotients(weights: list[float], house: int) -> list[int]:
    seats = [0] * len(weights)
    for _ in range(house):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * seats[i] + 1), -i))
        seats[k] += 1
    return seats


@pytest.mark.parametrize("seed", range(3))
def test_apportionment(spark, seed):
    rng = random.Random(seed)
    weights = [float(rng.choice([0, 1, 3, 10, 500, rng.random() * 100])) for _ in range(rng.randint(2, 30))]
    house = rng.randint(0, 300)
    df = spark.createDataFrame([(k, w, house) for k, w in enumerate(weights)], "k int, w double, house bigint")
    got = [r.seats for r in mixing.sainte_lague(df, [], "w", "house", "k", "seats").orderBy("k").collect()]
    assert got == (highest_quotients(weights, house) if sum(weights) else [0] * len(weights))


def test_mix_meets_targets_and_repeats(spark, make):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randint(0, 300)), "en", f"s{k % 5}") for k in range(400)] + [(1000 + k, "a b c", "en", "tiny") for k in range(3)] + [(2000, "x " * 900, "en", None)]
    a = {r.doc_id: r for r in mixing.mix(make(rows)).collect()}
    b = {r.doc_id: r.taken for r in mixing.mix(make(rows, 7)).collect()}
    assert {k: r.taken for k, r in a.items()} == b
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    size = {s: sum(a[i].size for i, _, _, x in rows if x == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, fixed = {}, set()
    while True:
        left, share = sum(size.values()) - sum(3 * size[s] for s in fixed), sum(weight[s] for s in names if s not in fixed)
        target = {s: 3 * size[s] if s in fixed else left * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        fixed |= over
    for s in names:
        ids = [i for i, _, _, x in rows if x == s]
        assert abs(a[ids[0]].target - target[s]) < 1e-6 and a[ids[0]].source_size == size[s]
        assert abs(sum(a[i].taken for i in ids) - target[s]) <= max(2, 0.01 * target[s])
    assert all(r.taken <= 3 * r.size for r in a.values())


@pytest.mark.parametrize("shard_words", [1_000_000, 20_000])
def test_whole_documents_meet_targets(make, monkeypatch, shard_words):
    monkeypatch.setattr(mixing, "SHARD_WORDS", shard_words)
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randint(50, 500)), "en", "hot" if k < 600 else f"s{k % 6}") for k in range(1200)]
    for weights in ((1, 2, 3), (1, 9, 9)):  # the hot source shrinks, to less than a fifth and further
        taken = mixing.mix(make(rows), weights=weights).groupBy("source").agg(F.max("target").alias("target"), F.max("source_size").alias("size"))
        plan = {r.source: r for r in taken.collect()}
        kept = mixing.mixed_documents(make(rows), weights=weights).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("words"))
        kept = {r.source: r.words for r in kept.collect()}
        assert plan["hot"].target < 0.25 * plan["hot"].size
        for s, r in plan.items():
            shards = -(-r.size // shard_words)
            assert abs(kept[s] - r.target) <= 128 + 250 * shards, (s, kept[s], r.target)


def test_rows_without_id_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    rows = [(None, "one two three four five", "en", "a", 1)] * 2000 + [(k, "six seven eight", "en", "b", 1) for k in range(500)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    seen = []
    original = mixing.sainte_lague
    monkeypatch.setattr(mixing, "sainte_lague", lambda df, within, *a: (seen.append(df) if within else None, original(df, within, *a))[1])
    first, again = mixing.mix(docs).collect(), mixing.mix(docs).collect()
    shards = {r.shard: r.words for r in seen[0].filter("source_no = 1").collect()}
    assert len(shards) >= 15 and max(shards.values()) < 2000  # 10,000 words without ids in 20 shards
    key = lambda rows: sorted((r.doc_id or -1, r.source, r.size, r.taken) for r in rows)
    assert key(first) == key(again)
    for source in "ab":
        own = [r for r in first if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 128


# 3 -----------------------------------------------------------------------------------------------

def test_secrets(spark, small):
    texts = documents(spark, small)
    for r in queries.op3_secret_scan(spark, small).collect():
        base = brute.base_spans(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in base) for k in secret_scan.BASE)
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
        assert [x for x in r.spans.split(",") if x and not x.startswith("guess")] == [f"{k}:{s}:{e}" for k, s, e in base]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="tokenSECRET=: \"'abc0123456789ſKAKIA.\n", max_size=80))
def test_base_patterns(text):
    assert [x for x in secret_scan.spans(text) if x[0] != "guess"] == brute.base_spans(text)
    assert not secret_scan.spans(text) or re.search(secret_scan.TRIGGER, text)


def test_triggers_in_the_jvm(spark, make):
    texts = ["PASSWORD: abcdefghijkl", "Api_Key='abcdefghijkl'", "apikey  = abcdefghijkl", "AKIA" + "A" * 14, "f" * 16, 'Passwd" = "abcdefghijkl', "passphrase => kX9vQ2#mZr7Lp", "TOKEN=abcdefghijkl"]
    rows = secret_scan.scan(make([(k, t, "en", "a") for k, t in enumerate(texts)])).collect()
    assert {r.doc_id: [tuple(x) for x in r.secrets] for r in rows} == {k: secret_scan.spans(t) for k, t in enumerate(texts)} and all(r.secrets for r in rows)


def test_guess_costs():
    cost = secret_scan.log10_guesses
    assert cost("password") < cost("passw0rd2024") < cost("kX9vQ2mZr7Lp")
    assert cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 8 and cost("2024-05-06") < 6 and cost("abcdefgh") < 4
    assert cost("") == 0 and cost("x" * 50_000) < 10
    weak, strong = 'db password: changeme2024 ok', 'db passphrase: kX9vQ2#mZr7Lp ok'
    assert secret_scan.spans(weak) == [] or all(k == "assign" for k, *_ in secret_scan.spans(weak))
    assert secret_scan.spans(strong) == [("guess", 15, 28)]


RANDOM_8 = ["xK9#mQ2p", "hV7$kR3!", "Zq8rT5wN", "t%9Lw&4Z"]
EXPLAINED = ["changeme2024", "P@ssw0rd123", "qwertyuiop", "letmein!", "2024-05-06", "aaaaaaaa", "sunshine-2021", "october2023!", "abcabcabc", "placeholder", "yourpassword", "elephant99", "<your-token>", "example_key"]


@pytest.mark.parametrize("value", RANDOM_8)
def test_random_values_are_added(value):
    text = f"login: me pwd = {value} end"
    assert secret_scan.spans(text) == [("guess", 16, 24)] and re.search(secret_scan.TRIGGER, text)


@pytest.mark.parametrize("value", EXPLAINED)
def test_explained_values_are_withheld(value):
    assert [x for x in secret_scan.spans(f"pwd = {value} end") if x[0] == "guess"] == []


def test_words_are_ranked():
    rank = secret_scan.ranks(secret_scan.default_vocabulary())
    assert rank["password"] == 1 and rank["the"] < rank["house"] < rank["elephant"] and len(rank) > 20_000
    assert secret_scan.log10_guesses("elephant") < 6 < secret_scan.log10_guesses("tnahpele")


def test_many_spans_in_one_text():
    text = " ".join(f"token: abcdefghijkl{k:04d} pwd = hV7$kR3! x" for k in range(2000))
    found = secret_scan.spans(text)
    assert sum(k == "assign" for k, *_ in found) == sum(k == "guess" for k, *_ in found) == 2000


def least_cost(value: str) -> float:
    """Every way to split a short value."""
    cheap = {}
    both = secret_scan.both_cases(value)
    for s, e, c in secret_scan.segments(value, secret_scan.ranks(secret_scan.default_vocabulary())):
        cheap[s, e] = min(c, cheap.get((s, e), c))

    def best(s: int) -> float:
        if s == len(value):
            return 0.0
        return min(secret_scan.SEGMENT + min(cheap.get((s, e), 1e9), sum(secret_scan._letter_cost(c, both) for c in value[s:e])) + best(e) for e in range(s + 1, len(value) + 1))

    return best(0)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="pasword1290qwe-PK", max_size=9))
def test_guess_cost_is_least(value):
    assert secret_scan.log10_guesses(value) == pytest.approx(least_cost(value))


def test_redaction(spark):
    row = spark.createDataFrame([("see token = abcdefghijkl0 end",)], "text string")
    assert secret_scan.scan(row).select(secret_scan.redact(F.col("text"), F.col("secrets")).alias("x")).first().x == "see [assign] end"


# 4 -----------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(words=st.lists(st.sampled_from("abc"), max_size=30))
def test_repeated_words_plainly(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    _cases.append((" ".join(words), len(marked)))


_cases: list[tuple[str, int]] = []


def test_repeated_words(spark):
    cases = _cases or [("a b c d e a b c d e", 10)]
    df = spark.createDataFrame(cases, "text string, want bigint")
    assert quality_rules.text_features(df).filter("n_repeat_words <> want").count() == 0


def test_limits_adapt(spark, make):
    clean = [(k, " ".join(f"word{k}x{j}" for j in range(30)), "en", "a") for k in range(60)]
    code = [(100 + k, " ".join(f"w{k}x{j} <" for j in range(30)), "en", "code") for k in range(60)]
    junk = [(200 + k, " ".join(f"w{k}x{j} ##$$" for j in range(30)), "en", "a") for k in range(5)]
    kept = {r.doc_id for r in quality_rules.quality_filter(make(clean + junk)).collect()}
    assert kept == {i for i, *_ in clean}
    both = {r.doc_id for r in quality_rules.quality_filter(make(clean + code)).collect()}
    assert {i for i, *_ in clean} <= both


def test_salted_join_judges_alike(spark, make, monkeypatch):
    rows = make([(k, " ".join(f"w{k}x{j}" for j in range(12)) + " #" * (k % 9), "en", f"s{k % 3}") for k in range(80)])
    first = {tuple(r) for r in quality_rules.quality_report(rows).collect()}
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 1)
    assert {tuple(r) for r in quality_rules.quality_report(rows).collect()} == first


# 5 -----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec._public())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeth \n▁.,'_-(0123é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_codec_equals_library(library, text):
    c = sentencepiece_codec.codec(sentencepiece_codec._public())
    ids = library.encode(text)
    assert c.encode(text) == ids
    assert c.decode(ids) == library.decode(ids)


def test_codec_on_documents(spark, small, library):
    texts = documents(spark, small)
    rows = {r.doc_id: r for r in queries.op5_sentencepiece(spark, small).collect()}
    for i, t in texts.items():
        ids = library.encode(t or "")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == brute.sha(",".join(map(str, ids))) and rows[i].decoded_sha256 == brute.sha(library.decode(ids))


def test_encode_then_decode(spark, awkward):
    done = sentencepiece_codec.decode(sentencepiece_codec.encode(awkward))
    for r in done.select("text", "decoded").collect():
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_full_caches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(sentencepiece_codec, "CACHE", 3)
    monkeypatch.setattr(sentencepiece_codec, "PAIRS", 5)
    c = sentencepiece_codec.Codec(sentencepiece_codec._public())
    text = "the quick brown fox jumps over the lazy dog and the quick cat " * 3
    assert c.encode(text) == library.encode(text)


# 6 -----------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark, make):
    rng = random.Random(3)
    calm, bad = [f"calm{k}" for k in range(300)], [f"vilest{k}" for k in range(12)] + ["grubby", "rotten"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 6 == 0
        w = rng.choices(calm, k=rng.randint(5, 60)) + (rng.choices(bad, k=rng.randint(2, 5)) if toxic else [])
        rng.shuffle(w)
        rows.append((k, " ".join(w), "en", "a"))
        labels.append((k, 1, int(toxic)))
    got = toxicity.score(make(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 900 and 100 < len(held) < 260
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_scores_use_texts_only(spark, small, make):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    first = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    hidden = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    assert {r.doc_id: r.score for r in toxicity.score(other, hidden).collect()} == pytest.approx(first)


def _votes(rng, n: int):
    """Classes and votes: five voters of known rates, and one that mostly says what the first says."""
    y = rng.random(n) < 0.2
    true = [(0.9, 0.02), (0.8, 0.05), (0.7, 0.01), (0.6, 0.1), (0.85, 0.03)]
    v = [np.where(y, rng.random(n) < p, rng.random(n) < q) for p, q in true]
    v.append(np.where(rng.random(n) < 0.9, v[0], rng.random(n) < 0.3))
    return y, true, np.array(v).T.astype(int)


def test_label_model_finds_accuracies_and_correlations():
    y, true, v = _votes(np.random.default_rng(0), 60_000)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    m = toxicity.fit_label_model([f"v{k}" for k in range(6)], patterns, counts, 0.2)
    assert m.linked[5] == 0 or m.linked[0] == 5  # the copy is linked to its model, and its rates follow its vote
    child = 5 if m.linked[5] == 0 else 0
    assert (m.rates[child, :, 1] - m.rates[child, :, 0] > 0.5).all()
    for k in range(1, 5):
        if m.linked[k] < 0:
            assert abs(m.rates[k, 1, 0] - true[k][0]) < 0.06 and abs(m.rates[k, 0, 0] - true[k][1]) < 0.03
    assert ((m.posterior(v) >= 0.5) == y).mean() > 0.97


def test_posterior_by_brute_force(spark):
    rng = np.random.default_rng(1)
    names = [f"v{k}" for k in range(6)]
    m = toxicity.LabelModel(names, 0.3, [-1, 0, 0, 1, -1, 4], rng.uniform(0.05, 0.95, (6, 2, 2)))
    every = np.array([[x >> k & 1 for k in range(6)] for x in range(64)])

    def chance(pattern, y) -> float:
        out = 0.3 if y else 0.7
        for j, up in enumerate(m.linked):
            p = m.rates[j, y, pattern[up] if up >= 0 else 0]
            out *= p if pattern[j] else 1 - p
        return out

    both = np.array([[chance(x, y) for y in (0, 1)] for x in every])
    assert both.sum() == pytest.approx(1) and np.exp(m.log_chances(every)) == pytest.approx(both)
    want = both[:, 1] / both.sum(1)
    assert m.posterior(every) == pytest.approx(want)
    table = spark.createDataFrame([tuple(map(int, x)) for x in every], ", ".join(f"{n} int" for n in names))
    got = table.select(m.logit({n: F.col(n) == 1 for n in names}).alias("x")).collect()
    assert [1 / (1 + np.exp(-r.x)) for r in got] == pytest.approx(want.tolist())


def test_voters_are_not_nested():
    found = [("short", "tra", 5.0, True), ("short", "tras", 5.0, True), ("long", "trash", 5.0, True), ("word", "tra", 5.0, True), ("word", "trap", 3.0, False), ("ending", "rash", 4.0, True), ("long", "moron", 4.0, True), ("word", "ok", 4.0, True)]
    kept = {(e.kind, e.text): e.voter for e in toxicity.minimal(found)}
    assert kept.keys() == {("short", "tra"), ("ending", "rash"), ("long", "moron"), ("word", "ok")}
    assert len(set(kept.values())) == 4
    entries = [toxicity.Entry("tra", "short", 2.0, 0), toxicity.Entry("ok", "word", 1.0, 6), toxicity.Entry("ash", "ending", 3.0, -1)]
    row = dict(zip(toxicity.HITS, toxicity.count_hits(" trash ok trap okay stra ", toxicity._automaton(entries)), strict=True))
    assert (row["hits_short_0"], row["hits_word_0"], row["weight"], row["weak"], row["entries"], row["most"], row["halves"]) == (2, 1, 5.0, 3.0, 2, 2, 1)


# 7 -----------------------------------------------------------------------------------------------

def test_weak_digests_are_found_out(spark, make):
    rows = [(k, t, "en", "a") for k, t in enumerate(["aa", "ab", "aa", "b", "ab", "ac", "", None])]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(make(rows), lambda t: F.substring(t, 1, 1).cast("binary")).collect()}
    assert got == {0: (2, 2, False), 2: (2, 2, True), 1: (4, 2, False), 4: (4, 2, True), 3: (3, 1, True), 5: (5, 1, True), 6: (7, 2, False), 7: (7, 2, True)}


def test_state_settings_are_given_back(spark, make):
    before = {k: spark.conf.get(k, None) for k in exact_dedup.SETTINGS}
    exact_dedup.exact_groups(make([(1, "x", "en", "a")])).count()
    assert {k: spark.conf.get(k, None) for k in exact_dedup.SETTINGS} == before


# 8 -----------------------------------------------------------------------------------------------

@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_order(text):
    assert suffix_groups.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("bucket,block", [(1000, 16), (3, 4), (1, 8)])
def test_repeats(spark, make, bucket, block):
    rng = random.Random(bucket)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 120))) for _ in range(5)]
    texts: list[str | None] = [None, "", "a" * 300, "ab" * 100]
    for _ in range(120):
        t = list("".join(rng.choice(base)[rng.randint(0, 20) :][: rng.randint(10, 120)] if rng.random() < 0.6 else "".join(rng.choice("abé") for _ in range(30)) for _ in range(rng.randint(0, 4))))
        if t and rng.random() < 0.5:
            t[rng.randrange(len(t))] = "x"
        texts.append("".join(t))
    want = brute.repeats([(t or "").encode() for t in texts], 24)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(make([(k, t, "en", "a") for k, t in enumerate(texts)]), 24, 8, bucket, block).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_repeats_of_400_bytes(spark, small):
    texts = documents(spark, small)
    ids = sorted(texts)
    want = brute.repeats([(texts[i] or "").encode() for i in ids], 400)
    got = {r.doc_id: r for r in queries.op8_suffix_dedup(spark, small).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in ids] == [(*w[:3], brute.sha(w[3])) for w in want]


def test_passages_go_from_400_bytes_on(spark, tmp_path):
    """Of passages of over 50 words in two texts each, one of 399 bytes stays: the rule counts bytes."""
    rng = random.Random(8)
    said = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))
    passages = [said(60)[:399], said(60)[:400], "é" + said(60)[:398], said(90)]
    assert all(len(x.split()) > 50 for x in passages) and [len(x.encode()) for x in passages] == [399, 400, 400, 629]
    rows = [(2 * k + i, f"{said(40)}{i}{x}{i}{said(40)}") for k, x in enumerate(passages) for i in (0, 1)] + [(99, said(300))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    gone = {i: x for k, x in enumerate(passages) if k for i in (2 * k, 2 * k + 1)}
    assert got == {i: (len(t.encode()), len(gone.get(i, "").encode()), int(i in gone), brute.sha(t.replace(gone[i], "") if i in gone else t)) for i, t in rows}


def test_anchors_in_pieces(monkeypatch):
    data = np.random.default_rng(1).integers(97, 101, 9000).astype(np.uint8)
    ends = np.array([4000, 4000, 4100, 9000])
    whole = suffix_dedup.anchors(data, ends, 400, 64)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 1500)
    cover = lambda x: {(p, q) for a, b, q in zip(*(y.tolist() for y in x[:3]), strict=True) for p in range(a, b + 1)}
    assert cover(whole) == cover(suffix_dedup.anchors(data, ends, 400, 64))


# 9 -----------------------------------------------------------------------------------------------

def test_licence_variants(spark, make):
    mit = dict(license_scan.KNOWN)["MIT"]
    full = next(t for k, t in license_scan.KNOWN if k == "MIT" and t.startswith("Permission"))
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + full.upper().replace(",", " ,"), "en", "a"), (2, full + " Except mine.", "en", "a"),
        (3, "Some prose.\nreleased under the MIT Licence!\nmore\nLicensed under CC BY-NC 4.0.", "en", "a"), (4, mit, "en", "a"),
    ]
    got = {r.doc_id: (r.text_license, r.notice_licenses, r.n_notices) for r in license_scan.scan(make(rows)).collect()}
    assert got[1][0] == "MIT" and got[2][0] is None
    assert got[3] == (None, "CC-BY-NC-4.0,MIT", 2) and got[4][0] == "MIT"


DISTRIBUTED = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0-Perl"}


def test_whole_licences_are_known(spark, make):
    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no folder of licence texts here")
    texts = {k: open(f"{folder}/{k}", encoding="utf-8").read() for k in DISTRIBUTED if os.path.exists(f"{folder}/{k}")}
    rows = [(k, ("© 2021 Someone\n" + t.upper().replace(" LICENSE", " LICENCE")), "en", name) for k, (name, t) in enumerate(texts.items())]
    rows += [(100 + k, t[: len(t) // 2], "en", name) for k, (name, t) in enumerate(texts.items())]
    got = {r.doc_id: r.text_license for r in license_scan.scan(make(rows)).collect()}
    assert [got[k] for k in range(len(texts))] == [DISTRIBUTED[name] for name in texts] and not any(got[100 + k] for k in range(len(texts)))


def test_licences_of_a_folder(spark, make, tmp_path):
    (tmp_path / "House-1.0.txt").write_text("Copyright 2020 Us\nYou may use this in our house.\n")
    (tmp_path / "Other").write_text("Not permitted.")
    got = {r.doc_id: r.text_license for r in license_scan.scan(make([(1, "you may use this, in our house", "en", "a"), (2, "Not permitted!", "en", "a"), (3, "x", "en", "a")]), folder=str(tmp_path)).collect()}
    assert got == {1: "House-1.0", 2: "Other", 3: None}


# 10 ----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def similar():
    rng = random.Random(5)
    v = [f"w{k}" for k in range(400)]
    hot, passage = [rng.choice(v) for _ in range(100)], [rng.choice(v) for _ in range(60)]
    texts: list[str | None] = [None, "", "a b", "a b", "a b c d e"]
    for _ in range(150):
        t = list(hot)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(v)
        texts.append(" ".join(t))
    texts += [" ".join([rng.choice(v) for _ in range(rng.randint(5, 60))] + passage + [rng.choice(v) for _ in range(rng.randint(5, 60))]) for _ in range(150)]
    return [(k, t, "en", "a") for k, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"small": 40}, {"tokens": 3000}])
def test_near_classes(spark, make, similar, options):
    want = brute.near([(i, t) for i, t, *_ in similar])
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies, r.n_doc_links) for r in near_join.near_duplicates(make(similar), target=0.9999, **options).collect()}
    assert got.keys() == want.keys()
    assert sum(got[i][1] for i in got) >= 0.99 * sum(want[i][1] for i in want) and all(got[i][1] <= want[i][1] for i in got)
    assert sum(got[i][0] != want[i][0] for i in got) <= 1 and all(got[i][2] == want[i][2] for i in got)
    for i, own in brute.near_documents([(i, t) for i, t, *_ in similar]).items():
        assert got[i][3] <= own and (got[i][1] < want[i][1] or got[i][3] == own)


def test_near_recall_on_documents(spark, small):
    want = brute.near(list(documents(spark, small).items()))
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in queries.op10_jaccard_join(spark, small).collect()}
    assert sum(g[1] for g in got.values()) >= 0.98 * sum(w[1] for w in want.values())
    assert sum(got[i][0] == want[i][0] for i in want) >= 0.99 * len(want)


def test_near_recall_of_split_buckets(make):
    rng = random.Random(11)
    passages = [[f"p{k}w{j}" for j in range(40)] for k in range(80)]
    texts = []
    for _ in range(600):  # pairs at a similarity of just 0.8 whose shingles many other texts have too
        *both, mine, other = rng.sample(passages, 10)
        same = [w for p in both for w in p]
        texts += [" ".join(same + mine), " ".join(same + other[:39])]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    want = brute.near([(i, t) for i, t, *_ in rows])
    got = near_join.near_duplicates(make(rows), small=12).agg(F.sum("n_links")).first()[0]
    assert 0.99 * sum(w[1] for w in want.values()) <= got <= sum(w[1] for w in want.values()) == 1200
    assert near_join.recall(*near_join.runs()) >= near_join.TARGET_RECALL


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(400 + k, 401 + k) for k in range(30)]
    got = {r.node: r.root for r in near_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert {x: got.get(x, x) for x in touched} == {x: find(x) for x in touched}
