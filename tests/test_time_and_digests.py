"""Joins by time, sessions of streams that come out of order, and trees of digests."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from graphlore.operators import incremental, merkle, temporal
from graphlore.streaming import cache, events

SCHEMA = "id bigint, user_id string, at timestamp"
START = datetime.datetime(2024, 1, 1)


def rows(spark, seed: int, n: int, first: int = 0):
    rng = random.Random(seed)
    made = [(first + k, rng.choice(["a"] * 8 + ["b", "c", None]), None if rng.random() < 0.05 else START + datetime.timedelta(minutes=rng.randrange(6000))) for k in range(n)]
    return made, spark.createDataFrame(made, SCHEMA)


@pytest.mark.parametrize("width", [60, 3600, 10**7])
def test_last_row_before(spark, width):
    asked, left = rows(spark, 1, 120)
    held, right = rows(spark, 2, 90, 1000)
    got = {r.id: r.found and r.found.id for r in temporal.asof(left, right, ["user_id"], "at", "id", width).collect()}
    order = lambda t: (t is not None, t or START)
    assert len(got) == 120
    for i, user, at in asked:
        before = [(order(t), k) for k, u, t in held if u == user and order(t) <= order(at)]
        assert got[i] == (max(before)[1] if before else None), i


@pytest.mark.parametrize("before,after", [(0, 0), (3600, 0), (7200, 1800), (0, 60)])
def test_rows_within_an_interval(spark, before, after):
    asked, left = rows(spark, 3, 100)
    held, right = rows(spark, 4, 150, 1000)
    got = sorted((r.l.id, r.r.id) for r in temporal.within(left, right, ["user_id"], "at", before, after).collect())
    want = sorted((i, k) for i, u, t in asked for k, v, s in held if u and u == v and t and s and -before <= (s - t).total_seconds() <= after)
    assert got == want
    plan = temporal.within(left, right, ["user_id"], "at", before, after)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_rows(spark):
    _, left = rows(spark, 5, 5)
    assert temporal.asof(left.filter("id < 0"), left, ["user_id"], "at", "id").count() == 0
    assert all(r.found is None for r in temporal.asof(left, left.filter("id < 0"), ["user_id"], "at", "id").collect())
    assert temporal.within(left, left.filter("id < 0"), ["user_id"], "at", 60).count() == 0


def test_sessions_drop_what_comes_too_late(spark, tmp_path):
    """Four files in turn; the last holds an event that its batch's watermark has passed, and one that is late but in time."""
    at = lambda m: START + datetime.timedelta(minutes=m)
    files = [
        [(1, at(0), 1, 1.0), (2, at(20), 1, 2.0), (3, at(5), 2, 4.0)],
        [(4, at(200), 1, 8.0)],
        [(8, at(201), 9, 0.5)],
        [(5, at(10), 2, 16.0), (6, at(175), 2, 32.0), (7, at(600), 3, 64.0)],
    ]
    schema = "event_id bigint, ts timestamp, user_id bigint, value double"
    for k, batch in enumerate(files):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
        for f in (tmp_path / f"{k}").glob("*.parquet"):
            f.rename(tmp_path / f"part-{k}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "part-*.parquet"))
    got = sorted((r.user_id, r.start, r.events, r.total) for r in events.drain(events.sessions(stream), "sessions-test").collect())
    # when the last file comes, the latest time two files before it was 200: what ended by 190 is done, the event of minute 10 is dropped
    assert got == [(1, at(0), 2, 3.0), (1, at(200), 1, 8.0), (2, at(5), 1, 4.0), (2, at(175), 1, 32.0), (9, at(201), 1, 0.5)]
    whole = events.sessions(spark.createDataFrame([r for b in files for r in b], schema)).collect()
    assert sorted((r.user_id, r.events) for r in whole) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (9, 1)]


def keyed(spark, pairs):
    return merkle.digested(spark.createDataFrame(pairs, "key string, payload string"), "key", "payload")


@pytest.mark.parametrize("depth", [0, 1, 3, None])
def test_trees(spark, depth):
    rng = random.Random(7)
    pairs = [(f"k{k}", f"p{rng.randrange(9)}") for k in range(700)]
    shuffled = rng.sample(pairs, len(pairs))
    one, same = merkle.identity(keyed(spark, pairs), depth).first(), merkle.identity(keyed(spark, shuffled).repartition(7), depth).first()
    assert one == same and one.rows == 700
    other = [(k, "changed" if k == "k5" else p) for k, p in pairs if k != "k9"] + [("new", "p")]
    assert merkle.identity(keyed(spark, other), depth).first().digest != one.digest
    got = sorted(tuple(r) for r in merkle.differing(keyed(spark, pairs), keyed(spark, other), depth).collect())
    assert got == [("k5", "changed"), ("k9", "missing"), ("new", "unexpected")]
    assert merkle.differing(keyed(spark, pairs), keyed(spark, shuffled), depth).count() == 0


def test_tree_shape_and_edges(spark):
    assert [merkle.depth_for(n) for n in (0, 256, 257, 4096, 4097, 10**12)] == [0, 0, 1, 1, 2, 8]
    pairs = [(f"k{k}", "p") for k in range(3000)]
    for level in merkle.levels(keyed(spark, pairs), 2):
        assert level.agg(F.sum("n")).first()[0] == 3000
    none = keyed(spark, pairs).filter("key = ''")
    assert merkle.identity(none).first().rows == 0 and merkle.differing(none, none).count() == 0
    assert merkle.differing(none, keyed(spark, pairs[:2])).count() == 2
    # rows that are repeated are counted, not gathered
    twice = keyed(spark, [("a", "p")] * 500 + [(None, None)])
    assert twice.count() == 2 and merkle.identity(twice).first().digest != merkle.identity(keyed(spark, [("a", "p"), (None, None)])).first().digest


def test_delta_identity_is_the_root(spark):
    delta = spark.createDataFrame([("upsert", "a", "1"), ("upsert", "b", "2")], "operation string, key string, payload string")
    assert incremental.identity(delta).first() == incremental.identity(delta.orderBy(F.desc("key")).repartition(3)).first()


def test_cache_over_batches(spark, tmp_path):
    """A value lives across micro-batches, ends by its timer or at the next miss, and does so once."""
    at = lambda m: START + datetime.timedelta(minutes=m)
    files = [[("a", at(0)), ("a", at(59)), ("b", at(30)), (None, at(1))], [("a", at(58)), ("a", at(60))], [("c", at(500))], [("a", at(501))]]
    for k, batch in enumerate(files):
        spark.createDataFrame(batch, "who string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"{k}"))
        for f in (tmp_path / f"{k}").glob("*.parquet"):
            f.rename(tmp_path / f"part-{k}.parquet")
    stream = spark.readStream.schema("who string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part-*.parquet"))
    before = spark.conf.get(cache.PROVIDER)
    got = sorted((r.key, r.at, r.outcome) for r in cache.replay(stream, "who", 3600).collect())
    assert spark.conf.get(cache.PROVIDER) == before
    assert got == sorted([
        ("a", at(0), "miss"), ("a", at(59), "hit"), ("a", at(58), "hit"), ("a", at(60), "expired"), ("a", at(60), "miss"), ("a", at(120), "expired"), ("a", at(501), "miss"),
        ("b", at(30), "miss"), ("b", at(90), "expired"), ("c", at(500), "miss"), ("null", at(1), "miss"), ("null", at(61), "expired"),
    ])


def test_trees_are_descended_over_written_tables(spark, monkeypatch):
    """Rows and nodes are read where they were written: no scan of the tables below, and few shuffles in the last plan."""
    from graphlore.operators import merkle

    names, held = [], merkle.cut
    monkeypatch.setattr(merkle, "cut", lambda df, name: names.append(name) or held(df, name))
    a = merkle.digested(spark.range(40).selectExpr("id AS key", "id * 2 AS v"), "key", "v")
    b = merkle.digested(spark.range(1, 41).selectExpr("id AS key", "id * 2 + cast(id = 7 AS INT) AS v"), "key", "v")
    found = merkle.differing(a, b, depth=1)
    assert {tuple(r) for r in found.collect()} == {("0", "missing"), ("40", "unexpected"), ("7", "changed")}
    assert sorted(names) == ["tree-leaves"] * 2 + ["tree-nodes"] * 2 + ["tree-rows"] * 2
