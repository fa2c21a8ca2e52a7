"""All pairs of alike vectors against brute force: awkward rows, hot buckets in blocks, recall at the threshold itself."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlore.operators import alike as alike_operators
from graphlore.operators import every_pair
from graphlore.operators.alike import Alike, Slots, _padded, choose, meeting, within
from graphlore.operators.every_pair import _comparer
from graphlore.operators.vectors import PIECE, _pieces, hashed_words
from graphlore.plans import alike_queries

KIND = "id bigint, embedding array<double>, a string, run int"


def table(spark, rows):
    return spark.createDataFrame([(k, v and [x if x is None else float(x) for x in v], "x", 3) for k, v in rows], KIND)


def brute(rows, threshold):
    first = {}
    for k, v in rows:
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            first[tuple(v)] = min(k, first.get(tuple(v), k))
    ids = sorted(first.values())
    at = {k: np.array(v) / np.linalg.norm(v) for v, k in first.items()}
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if at[a] @ at[b] >= threshold}


def found(alike):
    got = [(r.a, r.b) for r in alike.pairs().collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(5), []
    for k in range(240):
        # a third of all rows lie close together, some of them equal
        v = np.r_[9, 0, 0, 0, 0, 0] + rng.integers(0, 3, 6) if k % 3 == 0 else rng.normal(size=6)
        out.append((k, [float(x) for x in v]))
    out += [(500, None), (501, [0.0] * 6), (502, [1.0, None, 0, 0, 0, 0]), (503, [float("nan")] * 6), (504, [float("inf"), 0, 0, 0, 0, 0]), (None, [1.0] * 6), (505, out[4][1]), (505, out[4][1])]
    return out + [(506, [-0.0, 1, 0, 0, 0, 0]), (507, [0.0, 1, 0, 0, 0, 0])]


@pytest.mark.parametrize("slots, small", [(None, 4096), (None, 16), (Slots(6, math.sqrt(0.1), 4, 2, 24), 9)])
def test_pairs_equal_brute_force(spark, rows, slots, small):
    alike = Alike(table(spark, rows).repartition(3), 0.95, small=small, slots=slots)
    assert found(alike) == brute(rows, 0.95)
    work = alike.compared().first()
    assert work.n_all == alike.n * (alike.n - 1) // 2 and work.n_compared > 0


def test_links_count_vectors_and_rows(spark, rows):
    alike = Alike(table(spark, rows), 0.95)
    got = {r.id: r for r in alike.links().collect()}
    pairs, copies = brute(rows, 0.95), {r.vector_id: r.n_copies for r in got.values()}
    assert not {500, 501, 502, 503, 504, None} & set(got)
    assert got[505].vector_id == 4 and got[505].n_copies == 3 and got[507].vector_id == 506  # both zeros are one
    for r in got.values():
        near = [b if a == r.vector_id else a for a, b in pairs if r.vector_id in (a, b)]
        assert (r.n_links, r.n_row_links) == (len(near), sum(copies[x] for x in near) + r.n_copies - 1)


def test_empty_table_and_wrong_arguments(spark):
    alike = Alike(table(spark, []), 0.9)
    assert found(alike) == set() and alike.links().count() == 0
    assert alike.compared().first().n_compared == 0
    for threshold in (0, 1, -1):
        with pytest.raises(ValueError):
            Alike(table(spark, []), threshold)


def test_vectors_of_two_lengths_are_an_error(spark):
    with pytest.raises(Exception, match="inhomogeneous|elements|reshape"):
        found(Alike(table(spark, [(1, [1.0, 2.0]), (2, [1.0])]), 0.9))


def test_pairs_at_the_threshold_meet_as_often_as_promised():
    rng = np.random.default_rng(3)
    u = rng.normal(size=(4000, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    side = rng.normal(size=u.shape)
    side -= (side * u).sum(axis=1, keepdims=True) * u
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    v = 0.9 * u + math.sqrt(1 - 0.81) * side
    slots = choose(u, 4000, 0.9, target=0.95)
    assert slots.depth > 1 and slots.runs > 1
    met = (slots.keys(u) == slots.keys(v)).any(axis=1).mean()
    assert abs(met - 0.95) < 0.03  # whole runs, so somewhat above
    one = Slots(32, math.sqrt(0.2), 4, 1, 400)
    assert abs((one.slots(u[:500]) == one.slots(v[:500])).mean() - meeting(4)) < 0.02


def test_the_choice_follows_what_pairs_cost():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(3000, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    few, many = choose(u, 30, 0.95), choose(u, 10**9, 0.95)
    assert few.depth == 0 and few.runs == 1  # one bucket: brute force
    assert many.depth > choose(u, 10**5, 0.95).depth > 0


def test_within_in_blocks_is_exact(spark, rows):
    made = table(spark, rows).filter("id < 500")
    asked = made.filter("id % 10 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    once = {(r.query, r.id) for r in within(made, asked, 0.95).collect()}
    assert once == {(r.query, r.id) for r in within(made, asked, 0.95, block=6).collect()}
    assert {(min(p), max(p)) for p in once if p[0] != p[1]} >= {p for p in brute(rows, 0.95) if p[0] % 10 == 0 and p[1] < 500}
    assert within(made, asked.limit(0), 0.95).count() == 0


def test_hashed_words(spark):
    import hashlib

    texts = [(1, "a b  a\tc"), (2, None), (3, " \n"), (4, "ä" * 3), (5, "w " * 20000)]
    got = {r.id: r.embedding for r in hashed_words(spark.createDataFrame(texts, "id bigint, text string"), 8).collect()}
    want = {}
    for k, t in texts:
        for w in (t or "").split():
            h = hashlib.md5(w.encode()).digest()
            want.setdefault(k, [0.0] * 8)[h[0] % 8] += 1 if h[1] % 2 == 0 else -1
    assert got == want


def test_a_pair_exactly_at_the_threshold_and_many_near_it_are_all_found(spark):
    """Cosines of 49/50 as whole numbers give them, which unit vectors miss by rounding; no pair of a larger table is lost."""
    edge = [(k, [float(1 + (k == j % 7)) if j < 47 else 0.0 for j in range(64)]) for k in range(7)]
    base = [1.0] * 50 + [0.0] * 14
    edge += [(100 + k, [x if j != k else 0.0 for j, x in enumerate(base[:-1])] + [float(k >= 0)]) for k in range(-1, 40)]
    rng = np.random.default_rng(5)
    many = [(1000 + k, (np.array(edge[k % len(edge)][1]) * 3 + rng.integers(-1, 2, 64)).tolist()) for k in range(1500)]
    m = np.array([v for _, v in edge + many])
    ids, dots = np.array([k for k, _ in edge + many]), m @ m.T
    cosines = dots / np.sqrt(np.outer(dots.diagonal(), dots.diagonal()))
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(cosines >= 0.98), strict=True) if ids[i] < ids[j]}
    rows = spark.createDataFrame(edge + many, "id bigint, embedding array<float>")
    assert len([1 for a, b in want if a < 1000 and b < 1000 and cosines[list(ids).index(a), list(ids).index(b)] == 0.98]) > 5
    alike = Alike(rows, 0.98, exact=True, small=200)
    assert {(r.a, r.b) for r in alike.pairs().collect()} == want and alike.compared().first().n_compared == alike.n * (alike.n - 1) // 2
    assert {(r.a, r.b) for r in alike.pairs(every=50).collect()} == {x for x in want if x[0] % 50 == 0 or x[1] % 50 == 0}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def clusters(rows):
    """Far groups of vectors, one of them of multiples, which no tree can part."""
    rng = np.random.default_rng(9)
    out = [(1000 + k, (np.eye(6)[k % 5] * (9 if k % 2 else -9) + rng.integers(-1, 2, 6)).tolist()) for k in range(300)]
    return rows + out + [(2000 + k, [float(k + 1), float(2 * k + 2), 0.0, 0.0, 0.0, 0.0]) for k in range(90)]


@pytest.mark.parametrize("small", [25, 4096])
def test_every_pair_in_cells_that_are_blocks_or_several(spark, clusters, small):
    alike, want = Alike(table(spark, clusters).repartition(3), 0.95, small=small, exact=True), brute(clusters, 0.95)
    alike.every.small = small
    alike.every.reach, alike.every.tasks = alike.every._reach()  # smaller blocks than so few vectors would have
    assert found(alike) == want
    assert {(r.a, r.b) for r in alike.pairs(every=3).collect()} == {x for x in want if x[0] % 3 == 0 or x[1] % 3 == 0}
    got = {r.vector_id: r for r in alike.links().collect()}
    ends = [e for x in want for e in x]
    assert {k: r.n_links for k, r in got.items()} == {k: ends.count(k) for k in got}
    if small == 25:
        reach = alike.every.reach.collect()
        blocks = sum(r.parts for r in reach)
        assert max(r.parts for r in reach) >= 4  # the multiples
        assert sum(r.parts * len(r.others) for r in reach) < blocks * blocks  # far ones are not sent to each other


def test_links_are_counted_where_they_are_found(spark):
    """A row leaves a task for each vector and block, not one for each pair; pairs asked for are not made of all pairs."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(k, (50 + rng.integers(0, 9, 8)).astype(float).tolist()) for k in range(900)], "id bigint, embedding array<double>")
    alike = Alike(rows, 0.9, exact=True, small=100)
    assert {r.n_links for r in alike.links().collect()} == {alike.n - 1}
    assert "Union" not in plan(alike.links())
    counted = alike.every._dealt(1).mapInArrow(_comparer(alike.every.tree, 0.9, 1, links=True), "vector_id bigint, n_links bigint, others bigint")
    assert counted.count() <= alike.n * sum(r.parts for r in alike.every.reach.collect())
    assert alike.every._dealt(50).count() <= alike.n + 18 * sum(r.parts for r in alike.every.reach.collect())


def test_words_are_counted_in_whole_texts(spark):
    """No row is made of a word; a text is taken in pieces that end at white space."""
    assert "Generate" not in plan(hashed_words(spark.createDataFrame([(1, "a")], "id bigint, text string")))
    text = b" a\x0bb " + b"c" * (PIECE + 3) + b"\td\x85 \xc2\xa0 e" + b" fg" * PIECE
    assert [w for p in _pieces(text) for w in p.split()] == text.split() and b"".join(_pieces(text)) == text
    assert max(map(len, _pieces(text))) < 2 * PIECE + 10


def test_cells_of_many_pairs_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(every_pair, "MOST_FOUND", 1000)
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(k, (50 + rng.integers(0, 9, 8)).astype(float).tolist()) for k in range(300)], "id bigint, embedding array<double>")
    alike = Alike(rows, 0.9, exact=True)
    assert alike.every.reach.first().parts == 7  # 45,000 pairs foretold
    assert len(found(alike)) == alike.n * (alike.n - 1) // 2


def test_pairs_are_rounded_without_decimals(spark, small):
    assert "round(" not in plan(alike_queries.vector_pairs(spark, small))


def test_looking_up_takes_odd_vectors_and_no_lists(spark, rows, monkeypatch):
    """Null, infinite and missing elements are like nothing and hide no other pair; sound vectors are read as arrays."""
    made = table(spark, [r for r in rows if r[0] is not None])
    asked = made.filter("id % 10 = 0 or id between 501 and 504").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    got = [(r.query, r.id) for r in within(made, asked, 0.95).collect()]
    sound = {r[0]: np.array(r[1], dtype=float) / np.linalg.norm(r[1]) for r in rows if r[0] is not None and not 500 <= r[0] <= 504}
    want = {(a, b) for a in sound for b in sound if a % 10 == 0 and sound[a] @ sound[b] >= 0.95}
    assert set(got) == want and len(got) > len(asked.collect())
    column = pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32()))
    monkeypatch.setattr(alike_operators, "whole", lambda c: np.array([[7.0, 8.0]]))
    assert _padded(column).tolist() == [[7.0, 8.0]]


def test_vectors_are_named_once_for_all_lookups(spark, small):
    assert plan(alike_queries.vector_pairs_work(spark, small)).count("named-vectors") > 0


def test_every_pair_of_none_and_of_one(spark):
    for rows, n in (([], 0), ([(1, None), (2, [0.0, 0.0])], 0), ([(1, [1.0, 2.0]), (3, [1.0, 2.0])], 1)):
        alike = Alike(table(spark, rows), 0.9, exact=True)
        assert found(alike) == set() and alike.pairs(every=2).count() == 0 and alike.compared().first().n_compared == 0
        assert sorted((r.id, r.n_links, r.n_row_links) for r in alike.links().collect()) == [(1, 0, 1), (3, 0, 1)][: 2 * n]
