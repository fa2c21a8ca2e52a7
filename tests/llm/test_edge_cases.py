"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphlore.llm import chat_format, exact_dedup, license_scan, mixing, near_join, quality_rules, secret_scan, sentencepiece_codec, suffix_dedup, toxicity

OPERATORS = {
    "mix": (mixing.mix, 11), "mixed_documents": (mixing.mixed_documents, None), "scan": (secret_scan.scan, 11), "quality_report": (quality_rules.quality_report, 11),
    "quality_filter": (quality_rules.quality_filter, None), "round_trip": (sentencepiece_codec.round_trip, 11), "exact_groups": (exact_dedup.exact_groups, 11),
    "deduplicate": (exact_dedup.deduplicate, None), "remove_repeats": (suffix_dedup.remove_repeats, 11), "licenses": (license_scan.scan, 11),
    "near_duplicates": (near_join.near_duplicates, 11), "one_of_each": (near_join.one_of_each, None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(name, awkward):
    run, n = OPERATORS[name]
    rows = run(awkward).collect()
    assert n is None or len(rows) == n
    if n is None:
        assert len({r.doc_id for r in rows}) >= 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, make):
    run, _ = OPERATORS[name]
    assert run(make([(1, "x", "en", "a")]).filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("name", ["quality_filter", "deduplicate", "one_of_each", "mixed_documents"])
def test_stages_keep_columns(name, awkward):
    assert OPERATORS[name][0](awkward).columns == awkward.columns


def test_defined_results(awkward):
    groups = {(r.doc_id, r.kept): (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(awkward).collect()}
    assert groups[(1, False)] == (2, 2) and groups[(2, True)] == (2, 2)  # a null text equals the empty one
    assert groups[(5, True)] == groups[(5, False)] == (5, 2)  # of repeated rows one stays
    assert groups[(6, False)] == (7, 2) and groups[(None, True)] == (None, 1)
    near = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in near_join.near_duplicates(awkward).collect()}
    assert near[1] == (1, 0, 1) and near[3] == (3, 0, 1) and near[7] == (6, 0, 2) and near[5] == (5, 0, 2)
    report = {r.doc_id: r for r in quality_rules.quality_report(awkward).collect()}
    assert report[1].n_words == 0 and report[1].base_failed and not report[1].kept and report[5].base_failed
    mixed = mixing.mix(awkward).collect()
    assert all(r.taken <= 3 * r.size for r in mixed) and sum(r.taken for r in mixed if r.doc_id in (1, 2, 3)) == 0
    assert [r.secrets for r in secret_scan.scan(awkward).filter("doc_id = 1").collect()] == [[]]


def test_defined_texts(awkward):
    """Bytes kept and licences found of the awkward rows."""
    kept = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, len(r.kept)) for r in suffix_dedup.remove_repeats(awkward).collect()))
    texts = [(r.doc_id or 0, (r.text or "").encode()) for r in awkward.select("doc_id", "text").collect()]
    want = sorted((i, len(t), *brute_removed(i, t)) for i, t in texts)
    assert kept == [(i, n, gone, spans, n - gone) for i, n, gone, spans in want]
    got = {r.doc_id: (r.text_license, r.notice_licenses, r.n_notices) for r in license_scan.scan(awkward).collect()}
    assert set(got.values()) == {(None, "", 0)} and len({r.text_digest for r in license_scan.scan(awkward).filter("doc_id <= 3").collect()}) == 1


def brute_removed(doc_id: int, text: bytes) -> tuple[int, int]:
    # the repeated row 5 and the run of one letter in row 8 repeat; nothing else has 400 bytes
    return (len(text), 1) if doc_id in (5, 8) else (0, 0)


def test_scores_ignore_other_columns(spark, awkward):
    clash = awkward
    for name in ("words", "toxic", "h", "pattern", "exclaims", "entry", "x", "kind"):
        clash = clash.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame([(k, 1, int(k == 6)) for k in range(10)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("idiot"))
    assert sorted((r.doc_id or 0, r.score) for r in toxicity.score(clash, labels).collect()) == sorted((r.doc_id or 0, r.score) for r in toxicity.score(awkward, labels).collect())


def test_toxicity_edges(spark, awkward):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = toxicity.score(awkward, labels).collect()
    assert len(rows) == 11 and all(0 <= r.score < 0.5 and r.predicted == 0 for r in rows)
    odd = spark.createDataFrame([(1, None, None), (2, 1, 1), (4, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(awkward, odd).count() == 11
    assert toxicity.score(awkward.filter("doc_id < 0"), odd).count() == 0


def test_chat_edges(spark):
    rows = [(None, 0, "user", "hi"), (1, None, None, None), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (2, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("prompt", F.lit("clash")).withColumn("messages", F.lit(3))
    done = {r.conv_id: r for r in chat_format.format_chat(chat_format.canonical_turns(df, "conv_id")).withColumn("read", chat_format.parse_chat(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in done[1].read] == [("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert len(done[None].read) == 1 and done[2].loss_spans[0].end - done[2].loss_spans[0].start == 100_000
    assert chat_format.canonical_turns(df.filter("conv_id > 5"), "conv_id").count() == 0


@pytest.mark.parametrize("key", ["found", "_print", "print", "v", "key", "all", "made", "_made", "own", "layout", "turns", "a.b", "role name"])
def test_chat_keys_of_any_name(spark, key):
    out = f"{key}_key" if key in ("layout", "turns") else key
    raw = spark.createDataFrame([("k1", '{"prompt": "q", "completion": "a"}'), ("k2", "no json")], f"`{key}` string, raw string")
    got = chat_format.turns_from_json(raw, key, "raw")
    assert got.columns == [out, "turns", "layout"]
    assert {r[0]: (r[2], r[1] and [tuple(t) for t in r[1]]) for r in got.collect()} == {"k1": ("prompt_completion", [("user", "q"), ("assistant", "a")]), "k2": ("unknown", None)}
    rows = spark.createDataFrame([("k1", 1, "assistant", "a"), ("k1", 0, "user", "q")], f"`{key}` string, turn int, role string, text string")
    done = chat_format.canonical_turns(rows, key)
    assert done.columns == [out, "turns", "layout"] and [tuple(t) for t in done.first()[1]] == [("user", "q"), ("assistant", "a")]
    assert chat_format.format_chat(done).columns == [out, "turns", "layout", "formatted", "loss_spans"]


def test_results_replace_columns_of_their_names(spark, make):
    rows = spark.createDataFrame([(1, [("user", "q")], "old", 3, "m")], "id int, turns array<struct<role:string,text:string>>, formatted string, loss_spans int, made string")
    got = chat_format.format_chat(rows)
    assert got.columns == ["id", "turns", "made", "formatted", "loss_spans"] and got.first().formatted == "<turn user>\nq</turn>\n" and got.first().made == "m"
    scanned = secret_scan.scan(make([(1, "hello", "en", "a")]).withColumn("secrets", F.lit("old")))
    assert scanned.columns.count("secrets") == 1 and scanned.first().secrets == []


def test_the_registry_grows_with_the_mappings():
    many = tuple(chat_format.Mapping(f"m{k}", fields=(("user", (f"q{k}",)), ("assistant", (f"a{k}",)))) for k in range(200))
    assert len(chat_format.registry(many)) == 200
