"""The pipeline's stages, each against a plain version on the rows that its predecessor kept."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphlore.llm import mixing, quality_rules
from graphlore.plans.shared import cut
from tests.llm import brute


@pytest.fixture(scope="module")
def steps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = cut(stage(spark, docs, small), f"test-{name}")
    return out


def test_columns(steps):
    names = list(steps)
    for name in names[1:-1]:
        assert steps[name].columns == steps["documents"].columns


def test_quality_keeps_the_kept(steps):
    kept = {r.doc_id for r in quality_rules.quality_report(steps["documents"]).filter("kept").collect()}
    assert {r.doc_id for r in steps["quality"].collect()} == kept and 0 < len(kept) < steps["documents"].count()


def test_exact_keeps_the_greatest(steps):
    best: dict[str, int] = {}
    for r in steps["quality"].collect():
        best[r.text] = max(r.doc_id, best.get(r.text, -1))
    assert sorted(r.doc_id for r in steps["exact"].collect()) == sorted(best.values())


def test_near_keeps_one_of_each(steps):
    classes = brute.near([(r.doc_id, r.text) for r in steps["exact"].collect()])
    assert sorted(r.doc_id for r in steps["near"].collect()) == sorted({c for c, *_ in classes.values()})


def test_mix_repeats_by_share(steps):
    rows = mixing.mix(steps["near"]).filter("taken > 0").collect()
    want = {r.doc_id: n for r in rows if (n := max(int(r.taken / r.size + 0.5), int(sum(2 * x.taken >= x.size for x in rows if x.source == r.source) == 0)))}
    assert collections.Counter(r.doc_id for r in steps["mix"].collect()) == want


def test_mix_meets_targets_in_words(steps):
    """Words of the documents that leave the stage, by source, against the targets over those that came in."""
    targets = {r.source: r.target for r in mixing.mix(steps["near"]).select("source", "target").distinct().collect()}
    longest, words = collections.Counter(), collections.Counter()
    for r in steps["near"].collect():
        longest[r.source] = max(longest[r.source], len(brute.words(r.text)))
    for r in steps["mix"].collect():
        words[r.source] += len(brute.words(r.text))
    assert sum(words.values()) == pytest.approx(sum(targets.values()), rel=0.05)  # sources have some ten documents here
    for source, target in targets.items():  # whole documents: as near as the longest one allows, and a block
        assert abs(words[source] - target) <= max(0.01 * target, longest[source] + 64), (source, words[source], target)


def test_tokens_round_trip(steps):
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in steps["mix"].collect()}
    rows = steps["tokens"].select("doc_id", "ids", "decoded_sha256").collect()
    assert len(rows) == steps["mix"].count()
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id]) and r.decoded_sha256 == brute.sha(library.decode(r.ids))


def test_run_is_the_stages(spark, small, steps):
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "ids_sha256").cast("decimal(38,0)"))).first()
    assert digest(corpus_pipeline.run(spark, small)) == digest(steps["tokens"])
