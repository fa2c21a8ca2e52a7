"""Every registered query against its SQL, and the shape of plans."""

from __future__ import annotations

import pytest

from graphlore.plans import alike_queries, catalogue_queries, corpus_queries, index_queries, pack_queries, retrieval_queries, time_queries  # noqa: F401
from graphlore.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, small):
    same(QUERIES[name], ORACLE_SQL[name], spark, small)


#: Approximate by nature; tests of their own hold them against what is exact.
NO_SQL = {"index_recall", "vector_pairs_work"}


def test_others_are_few():
    assert set(QUERIES) - set(ORACLE_SQL) == NO_SQL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["links_count", "backlinks", "delta_upsert", "delta_classify", "entity_edges_weighted", "endpoint_filter", "html_sections"])
def test_no_nested_loops(name, spark, small):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text


def test_top_k_and_pruning(spark, small):
    text = plan(QUERIES["knn_cosine_topk"](spark, small))
    assert "TakeOrderedAndProject" in text
    assert "PushedFilters: [IsNotNull(vec_id), EqualTo(vec_id,0)]" in text or "EqualTo(vec_id,0)" in text
    text = plan(QUERIES["category_counts"](spark, small))
    assert "text" not in text.split("ReadSchema")[1]


def test_group_limit_before_the_shuffle(spark, small):
    text = plan(QUERIES["knn_batch_top3"](spark, small))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
