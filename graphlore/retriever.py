"""Retrieval as one call: modes, optional stages and answers, with models given as functions.

Every stage adds to one DataFrame (id, score, rank), so Catalyst plans the
query as a whole; only the answer itself is put together on the driver, from
at most ``k`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlore.operators import fusion, vectors
from graphlore.plans import guard

#: The model seams: texts to vectors, (question, passages) to scores, question to SQL, prompt and context to an answer.
Embed = Callable[[list[str]], list[list[float]]]
Score = Callable[[str, list[str]], list[float]]


class QueryError(ValueError):
    """A question or option that cannot be answered."""


def embed_column(rows: DataFrame, text: str, embed: Embed, to: str = "embedding", batch: int = 64) -> DataFrame:
    """``rows`` with the vector of each text; every distinct text is embedded once, in batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for s in range(0, len(texts), batch):
            out += embed(texts.iloc[s : s + batch].tolist())
        return pd.Series(out)

    vector = rows.select(text).distinct().withColumn(to, run(F.col(text)))
    return rows.join(vector.withColumnRenamed(text, "_t"), F.col(text).eqNullSafe(F.col("_t")), "left").drop("_t")


def cross_encode(candidates: DataFrame, question: str, score: Score) -> DataFrame:
    """id, score, rank of candidates (id, content, rank) in the order of a model's scores."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score(question, texts.fillna("").tolist()), dtype="float64")

    scored = candidates.select("id", run(F.col("content")).alias("score"), F.col("rank").alias("_was"))
    return scored.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "_was", "id")).cast("bigint").alias("rank"))


def select_examples(examples: Sequence[dict], question: str, embed: Embed, n: int) -> list[dict]:
    """The ``n`` examples (id, text, vector) nearest to a question: by cosine, then id."""
    if n <= 0 or not examples:
        return []
    q = embed([question])[0]

    def cosine(v: Sequence[float]) -> float:
        norm = (sum(x * x for x in v) * sum(x * x for x in q)) ** 0.5
        return sum(a * b for a, b in zip(v, q, strict=True)) / norm if norm else 0.0

    return sorted(examples, key=lambda e: (-cosine(e["vector"]), e["id"]))[:n]


@dataclass
class Retriever:
    """Sections (id, title, content, embedding, further fields) and links (src, dst) with the models to search them."""

    sections: DataFrame
    links: DataFrame
    embed: Embed | None = None
    cross_encoder: Score | None = None
    generate_sql: Callable[[str], str] | None = None
    answer: Callable[[str, list[dict]], str] | None = None
    examples: Sequence[dict] = field(default_factory=list)
    lexical_fields: Sequence[str] = ("title", "content")

    def _vector(self, question: str) -> DataFrame:
        if self.embed is None:
            raise QueryError("this mode needs an embedder")
        return self.sections.sparkSession.createDataFrame([([float(x) for x in self.embed([question])[0]],)], "q array<float>")

    def _core(self, question: str, k: int, mode: str, weights: tuple[float, float, float]) -> DataFrame:
        if mode == "vector":
            return vectors.vector_retrieve(self.sections, self._vector(question), k)
        if mode == "hybrid":
            words = self.sections.sparkSession.range(1).select(fusion.keywords(F.lit(question)).alias("w")).first()["w"]
            return fusion.hybrid_retrieve(self.sections, self.links, self._vector(question), words, k, weights)
        if mode == "lexical":
            found = fusion.lexical_retrieve(self.sections, question, list(self.lexical_fields), k)
            if self.embed is None:
                return found
            both = fusion.union_by_max(found, vectors.vector_retrieve(self.sections, self._vector(question), k))
            return _cut(both.select("id", "score", F.col("source").alias("_was")), k)
        raise QueryError(f"unknown mode {mode!r}")

    def retrieve(self, question: str, k: int = 10, mode: str = "vector", weights: tuple[float, float, float] = fusion.WEIGHTS, generated: bool = False, rerank: bool = False, cross: bool = False) -> DataFrame:
        """id, content, score, rank. Generated rows are merged first; the reranker is left out where a cross-encoder follows."""
        if not isinstance(k, int) or k < 1:
            raise QueryError("k is a whole number from 1 on")
        found = self._core(question, k, mode, weights)
        if generated:
            if self.generate_sql is None:
                raise QueryError("there is nothing to generate queries with")
            rows = guard.run_read(self.sections.sparkSession, self.generate_sql(question), k).select("id", F.lit(1.0).alias("score"))
            merged = fusion.union_second_wins(found, rows)
            found = _cut(merged.select("id", "score", (-F.col("source")).alias("_was")), 2 * k)
        if rerank and not cross:
            found = fusion.graph_rerank(found, self.links)
        text = self.sections.select("id", "content")
        if cross:
            if self.cross_encoder is None:
                raise QueryError("there is no cross-encoder")
            found = cross_encode(found.join(text, "id"), question, self.cross_encoder)
        top = found.filter(F.col("rank") <= k)
        return top.join(text, "id", "left").select("id", "content", "score", "rank")

    def answer_from(self, question: str, k: int = 10, several: bool = True, examples: int = 0, **options) -> dict:
        """results, answer, cited and examples. Context is bounded as for any prompt; examples are shown and never cited."""
        if self.answer is None:
            raise QueryError("there is nothing to answer with")
        rows = [r.asDict() for r in self.retrieve(question, k, **options).orderBy("rank").collect()]
        context, used = [], 0
        for r in (rows if several else rows[:1])[:50]:
            part = (r["content"] or "")[:8_000]
            if used + len(part) > 60_000:
                break
            used += len(part)
            context.append({"id": str(r["id"]), "text": part})
        shown = select_examples(self.examples, question, self.embed, examples) if examples else []
        preamble = "Here are some examples of good answers:\n" + "\n".join(e["text"] for e in shown) + "\n\n" if shown else ""
        said = self.answer(preamble + question, context)
        return {"results": rows, "answer": said, "cited": cited(said, [c["id"] for c in context]), "examples": shown}


def _cut(rows: DataFrame, k: int) -> DataFrame:
    """id, score, rank of the best ``k`` of id, score, _was."""
    order = [F.desc(F.round("score", 9)), F.col("_was"), F.col("id")]
    return rows.orderBy(*order).limit(k).select("id", "score", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"))


def cited(answer: str, ids: Sequence[str]) -> list[str]:
    """Identifiers that an answer mentions, by their first mention; part of a longer identifier is no mention."""
    import re

    first = {}
    for i in dict.fromkeys(ids):
        if m := re.search(re.escape(i) + r"(?![A-Za-z0-9_#])", answer):
            first[i] = m.start()
    return sorted(first, key=first.get)


def list_size(asked: object, default: int = 3, most: int = 20) -> int:
    """How many items a model is asked for."""
    return max(1, min(most, int(asked))) if isinstance(asked, (int, float)) and not isinstance(asked, bool) else default


def run_eval(questions: DataFrame, arms: dict[str, Callable[[str], str]], judge: Callable[[dict, str], str], by_skill: dict[str, Callable[[dict, str], str]] | None = None) -> DataFrame:
    """arm, id, correct, score, reasoning: each arm's answer to each question (id, question), judged; answers run on executors, a failing one counts as wrong.

    ``by_skill``: judges of their own for the skills that questions name in ``skill``; all others have ``judge``.
    """
    from functools import reduce

    from graphlore.operators.evaluate import verdict

    def judged(ask: Callable[[str], str]):
        @F.pandas_udf("string")
        def run(rows: pd.DataFrame) -> pd.Series:
            said = []
            for r in rows.to_dict("records"):
                try:
                    own = (by_skill or {}).get(r.get("skill"), judge)
                    said.append(own(r, ask(r["question"])))
                except Exception:  # one question that fails is a wrong answer, not the end of the run
                    said.append("")
            return pd.Series(said)

        return run(F.struct(*[c for c in ("id", "question", "answer", "skill") if c in questions.columns]))

    each = [questions.select("id", verdict(judged(ask)).alias("v")).select(F.lit(name).alias("arm"), "id", "v.*") for name, ask in arms.items()]
    return reduce(DataFrame.unionByName, each)
