"""The retriever's stages with stand-ins for models, manifests, and evaluation runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphlore import retriever as r
from graphlore.operators import evaluate, fusion, vectors
from graphlore.sources import manifest

VECTORS = {"alpha": [1.0, 0.0], "beta": [0.0, 1.0]}


def embed(texts):
    return [VECTORS.get(t.split()[0].lower(), [0.6, 0.8]) for t in texts]


@pytest.fixture(scope="module")
def made(spark):
    rows = [(1, "Alpha", "first text", [1.0, 0.0]), (2, "Beta", "second text", [0.0, 1.0]), (3, "Gamma", "third text about alpha", [0.7, 0.7]), (4, "Delta", "last", [-1.0, 0.0])]
    sections = spark.createDataFrame(rows, "id bigint, title string, content string, embedding array<float>")
    sections.createOrReplaceTempView("pack_sections")
    return r.Retriever(sections, spark.createDataFrame([(1, 4)], "src bigint, dst bigint"), embed=embed)


def listed(df):
    return [(x.id, round(x.score, 6)) for x in df.orderBy("rank").collect()]


def test_flags_off_is_the_core(spark, made):
    core = vectors.vector_retrieve(made.sections, made._vector("alpha?"), 3)
    assert listed(made.retrieve("alpha?", 3)) == listed(core)
    hybrid = fusion.hybrid_retrieve(made.sections, made.links, made._vector("alpha things"), ["alpha", "things"], 3)
    assert listed(made.retrieve("alpha things", 3, "hybrid")) == listed(hybrid)


def test_lexical_takes_the_greater_score(made):
    got = dict(listed(made.retrieve("alpha", 4, "lexical")))
    assert got[1] == 1.0 and got[3] == 1.0


def test_generated_rows_and_guard(made):
    made.generate_sql = lambda q: "SELECT id FROM pack_sections WHERE title = 'Delta'"
    got = listed(made.retrieve("alpha", 2, generated=True))
    assert got[0][1] == 1.0 and 4 in [i for i, _ in got]
    made.generate_sql = lambda q: "DROP VIEW pack_sections"
    with pytest.raises(ValueError):
        made.retrieve("alpha", 2, generated=True)


def test_cross_encoder_replaces_the_reranker(made):
    made.cross_encoder = lambda q, texts: [float(len(t)) for t in texts]
    alone = listed(made.retrieve("alpha", 3, cross=True))
    assert alone == listed(made.retrieve("alpha", 3, cross=True, rerank=True))
    assert alone[0] == (3, 22.0)


def test_answers(made):
    made.answer = lambda prompt, context: f"by 3#x, then 3 and {context[0]['id']}; {len(context)}; {prompt.count(chr(10))}"
    made.examples = [{"id": "b", "text": "B", "vector": [1.0, 0.0]}, {"id": "a", "text": "A", "vector": [1.0, 0.0]}, {"id": "c", "text": "C", "vector": [0.0, 1.0]}]
    got = made.answer_from("alpha", 3, examples=2)
    assert [e["id"] for e in got["examples"]] == ["a", "b"] and got["cited"] == ["3", "1"] and "; 3; 4" in got["answer"]
    assert "; 1; 0" in made.answer_from("alpha", 3, several=False)["answer"]
    for k in (0, 1.5):
        with pytest.raises(r.QueryError):
            made.retrieve("alpha", k)
    with pytest.raises(r.QueryError):
        made.retrieve("alpha", 1, "other")
    assert [r.list_size(x) for x in (0, 7, 99, None, "x")] == [1, 7, 20, 3, 3]


def test_each_text_is_embedded_once(spark):
    rows = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha"), (4, None)], "id bigint, t string")
    got = {x.id: x.embedding for x in r.embed_column(rows.filter("t is not null"), "t", embed).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [1.0, 0.0]}


def test_eval_run(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "fail")], "id bigint, question string")

    def ask(q):
        if q == "fail":
            raise RuntimeError
        return q

    judge = lambda question, answer: '{"correct": true, "score": 1}' if answer == "a" else '{"correct": false}'
    rows = r.run_eval(questions, {"pack": ask, "baseline": lambda q: "a"}, judge)
    got = {x.arm: (x.questions, x.correct) for x in evaluate.arm_metrics(rows).collect()}
    assert got == {"pack": (3, 1), "baseline": (3, 3)}
    a, b = (rows.filter(F.col("arm") == n) for n in ("pack", "baseline"))
    assert tuple(evaluate.compare_arms(a, b).first()) == (0, 2, 1, 0.0)


def test_manifests(spark, tmp_path):
    good = {"name": "cve", "version": "1.0.0", "graph_stats": {"articles": 3, "size_mb": 2.5}, "eval_scores": None, "extra": [1], "constructor": 1}
    folder = f"file://{tmp_path}"
    manifest.save(spark, folder, good)
    manifest.save(spark, folder, good)
    assert manifest.load(spark, folder) == {k: v for k, v in good.items() if k != "constructor"}
    for bad in ({"name": "../x", "version": "1.0.0"}, {"name": "x", "version": "1"}, {**good, "graph_stats": {"n": -1}}, {**good, "eval_scores": {"n": float("nan")}}, [], {**good, "description": 1}):
        with pytest.raises(manifest.ManifestError):
            manifest.validate(bad)
