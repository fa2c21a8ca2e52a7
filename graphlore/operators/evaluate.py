"""Evaluation: sampling, arm metrics, comparison, usage, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified(questions: DataFrame, per_pack: int) -> DataFrame:
    """pack, skill, id, position: ``per_pack`` questions of each pack, taking skills in turn, in the order of id."""
    skill_of = questions.groupBy("pack", "skill").agg(F.min("id").alias("skill_order"))
    pack_of = questions.groupBy("pack").agg(F.min("id").alias("pack_order"))
    own = questions.select("pack", "skill", "id", F.row_number().over(Window.partitionBy("pack", "skill").orderBy("id")).alias("round")).filter(F.col("round") <= per_pack)
    ranked = own.join(skill_of, ["pack", "skill"]).withColumn("position", F.row_number().over(Window.partitionBy("pack").orderBy("round", "skill_order")).cast("bigint"))
    return ranked.filter(F.col("position") <= per_pack).join(pack_of, "pack").select("pack", "skill", "id", "position", "pack_order")


def arm_metrics(verdicts: DataFrame) -> DataFrame:
    """arm, questions, correct, accuracy, mean_score; zeros where there is nothing."""
    n, right = F.count(F.lit(1)), F.count_if("correct")
    return verdicts.groupBy("arm").agg(n.alias("questions"), right.alias("correct"), F.when(n > 0, right / n).otherwise(0.0).alias("accuracy"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))


def compare_arms(a: DataFrame, b: DataFrame) -> DataFrame:
    """wins, losses, ties and win_rate of arm a over arm b, question by question."""
    both = a.select("id", F.col("correct").alias("x")).join(b.select("id", F.col("correct").alias("y")), "id")
    counts = both.agg(F.count_if(F.expr("x and not y")).alias("wins"), F.count_if(F.expr("y and not x")).alias("losses"), F.count_if(F.expr("x = y")).alias("ties"))
    total = F.col("wins") + F.col("losses")
    return counts.withColumn("win_rate", F.when(total > 0, F.col("wins") / total).otherwise(0.0))


def verdict(text: Column) -> Column:
    """correct, score, reasoning of a judge's JSON; wrong, 0 and empty where it can't be read."""
    v = F.try_parse_json(text)
    correct = F.coalesce(F.try_variant_get(v, "$.correct", "boolean"), F.lit(False))
    score = F.try_variant_get(v, "$.score", "double")
    score = F.when(score.isNull() | F.isnan(score), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return F.struct(correct.alias("correct"), score.alias("score"), F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit("")).alias("reasoning"))


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """calls, input and output characters, summed."""
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("input").alias("input"), F.sum("output").alias("output"))


STAGES = ("embedding", "retrieved", "reranked", "answer")


def stage_parity(actual: DataFrame, golden: DataFrame, threshold: float = 0.999) -> DataFrame:
    """id, each stage's agreement and the first that differs. Columns: vector, retrieved, reranked, citations, seed."""
    from graphlore.operators.vectors import cosine, doubles

    a, g = actual.alias("a"), golden.alias("g")
    j = a.join(g, F.col("a.id") == F.col("g.id"))
    va, vg = F.col("a.vector"), F.col("g.vector")
    same = {
        "embedding": (F.size(va) == F.size(vg)) & (F.when(F.size(va) == F.size(vg), cosine(doubles(va), doubles(vg))).otherwise(0.0) >= threshold),
        "retrieved": F.col("a.retrieved") == F.col("g.retrieved"),
        "reranked": F.col("a.reranked") == F.col("g.reranked"),
        "answer": (F.array_sort(F.array_distinct("a.citations")) == F.array_sort(F.array_distinct("g.citations"))) & (F.col("a.seed") == F.col("g.seed")),
    }
    first = F.lit(None).cast("string")
    for s in reversed(STAGES):
        first = F.when(~same[s], s).otherwise(first)
    return j.select(F.col("a.id").alias("id"), *[c.alias(f"{s}_agrees") for s, c in same.items()], first.alias("first_difference"))


def adoption_gate(hits: DataFrame, arms: DataFrame, least_hits: float = 0.98, least_change: float = -0.02) -> DataFrame:
    """mean_hit, change, adopt: whether a smaller form may take the place of the full one.

    ``hits``: hit of each query; ``arms``: arm (``full`` or ``small``) and accuracy.
    """
    mean = hits.agg(F.avg("hit").alias("mean_hit"))
    change = arms.agg((F.max(F.when(F.col("arm") == "small", F.col("accuracy"))) - F.max(F.when(F.col("arm") == "full", F.col("accuracy")))).alias("change"))
    both = mean.join(F.broadcast(change))
    return both.withColumn("adopt", F.coalesce((F.col("mean_hit") >= least_hits) & (F.col("change") >= least_change), F.lit(False)))
