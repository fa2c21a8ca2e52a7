"""Relations by support against full rebuilds, and the checks of a pack."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphlore.functions.columns import strip
from graphlore.operators import support

SCHEMA = "article string, source string, target string, relation string, context string"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_a_run_of_deltas_equals_a_rebuild(spark, seed):
    rng = random.Random(seed)
    state = lambda a: {(a, rng.choice("xyz"), rng.choice("xyz"), "r", rng.choice(["", "c"])) for _ in range(rng.randrange(4))}
    now = {f"a{k}": state(f"a{k}") for k in range(12)}
    frame = lambda rows: spark.createDataFrame(sorted(rows), SCHEMA)
    held = frame(set().union(*now.values()))
    live = support.counts(held)
    for _ in range(2):
        names = rng.sample(sorted(now), 4) + [f"new{rng.randrange(99)}"]
        fresh = {a: state(a) for a in names[1:]}  # the first is removed
        changed = spark.createDataFrame([(a,) for a in names], "article string")
        added = frame(set().union(*fresh.values()))
        touched = support.changes(live, held, changed, added)
        live, held = support.maintained(live, touched), support.support_after(held, changed, added)
        now = {a: s for a, s in now.items() if a not in names} | fresh
        everything = set().union(*now.values())
        assert rows_of(held, *support.SUPPORT) == sorted(everything)
        assert rows_of(live, *support.RELATION, "n") == rows_of(support.counts(frame(everything)), *support.RELATION, "n")
        assert all(r.now >= 0 for r in touched.collect())
        strange, missing = support.unlike_support(live, held)
        assert strange.isEmpty() and missing.isEmpty()


def test_statements_are_cleaned(spark):
    stated = spark.createDataFrame([("a", " x ", "y\n", "r", None), ("a", "x", "y", "r", ""), ("a", "", "y", "r", "c"), ("a", None, "y", "r", "c"), ("b", "x", "y", "r", "c")], SCHEMA)
    assert rows_of(support.supported(stated), *support.SUPPORT) == [("a", "x", "y", "r", ""), ("b", "x", "y", "r", "c")]


def test_a_delta_is_applied_in_one_grouping(spark):
    """Relations without a name for their kind are counted too, and each table is scanned once."""
    held = spark.createDataFrame([("a", "x", "y", None, ""), ("b", "x", "y", None, ""), ("c", "x", "y", "r", "c"), (None, "p", "q", "r", "")], SCHEMA)
    changed, fresh = spark.createDataFrame([("b",), ("c",), ("c",)], "article string"), spark.createDataFrame([("b", "z", "y", "r", "c")], SCHEMA)
    live = support.counts(held)
    assert rows_of(support.changes(live, held, changed, fresh), "source", "target", "context", "was", "now") == [("x", "y", "", 2, 1), ("x", "y", "c", 1, 0), ("z", "y", "c", 0, 1)]
    assert rows_of(support.applied(live, held, changed, fresh), "source", "target", "context", "n") == [("p", "q", "", 1), ("x", "y", "", 1), ("z", "y", "c", 1)]


def test_support_is_written_once_for_all_its_uses(spark, small):
    from graphlore.plans import pack_queries

    before, _, _ = pack_queries._stated(spark, small)
    assert before.inputFiles() and all("/stated-" in f for f in before.inputFiles())
    plan = pack_queries.relation_support_delta(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftOuter" not in plan


def test_live_and_stated_relations_meet_in_one_grouping(spark):
    live = spark.createDataFrame([("e", "q", None, ""), ("e", "q", None, ""), ("s", "t", "r", "")], "source string, target string, relation string, context string")
    held = spark.createDataFrame([("A", "s", "t", "r", ""), ("B", "s", "t", "r", ""), ("B", "u", "v", "r", "")], SCHEMA)
    assert rows_of(support.compared(live, held), "source", "live", "stated") == [("e", 2, 0), ("s", 1, 1), ("u", 0, 1)]
    strange, missing = support.unlike_support(live, held)
    assert (strange.count(), missing.count()) == (2, 1)


def test_ends_are_stripped_of_white_space_alone(spark):
    """A next-line character is no white space, and what is before it stays; a pattern's end would match before it."""
    texts = {"\ufeff\u3000a b\u2003\t": "a b", "a \u0085": "a \u0085", " \n ": "", "": "", "x": "x"}
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", strip(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == texts | {None: None}


def test_validation_of_sound_empty_and_faulty_packs(spark):
    make = spark.createDataFrame
    article = make([("A",), ("B",)], "title string")
    section = make([(1, "A", 0, "text", [1.0]), (2, "A", 1, "text", [1.0]), (3, "B", 0, "text", [1.0])], "id bigint, article string, section_index bigint, content string, embedding array<float>")
    links = make([(1, 2)], "src bigint, dst bigint")
    entity, mention = make([("e",), ("f",)], "entity_id string"), make([("A", "e"), ("B", "f")], "article string, entity_id string")
    relation = make([("e", "f", "r", "")], "source string, target string, relation string, context string")
    held = make([("A", "e", "f", "r", "")], SCHEMA)
    found = lambda **k: {r.check_name: r.violations for r in support.validate(**({"article": article, "section": section, "links": links, "has_entity": mention, "entity": entity, "relation": relation, "size": 1, "support": held} | k)).collect()}
    sound = found()
    assert len(sound) == 24 and not any(sound.values())
    none = {k: v.filter("1 = 0") for k, v in {"article": article, "section": section, "links": links, "has_entity": mention, "entity": entity, "relation": relation, "support": held}.items()}
    assert not any(found(**none).values())
    bad = found(
        article=make([("A",), ("A",), (" ",), (None,)], "title string"), section=make([(1, "A", 0, "", [1.0]), (1, "A", 2, "t", [float("nan")]), (3, "Z", 0, "t", None), (4, None, 0, "t", [1.0])], section.schema),
        links=make([(1, 1), (1, 9), (1, 9), (8, None)], links.schema), has_entity=make([("A", "e"), ("A", "e"), ("Z", "x")], mention.schema), relation=make([("e", "q", "r", ""), ("q", "e", "r", ""), ("e", "q", "r", "")], relation.schema),
    )
    assert {k: v for k, v in bad.items() if v} == {
        "article title repeated": 1, "article without title": 2, "article without section": 2, "section id repeated": 1, "section without content": 1, "embedding unsound": 2, "section without article": 2, "sections not numbered from 0": 1,
        "link repeated": 1, "link to itself": 1, "link from nowhere": 1, "link to nowhere": 3, "mention repeated": 1, "mention in no article": 1, "mention of no entity": 1, "relation repeated": 1, "relation from nowhere": 1,
        "relation to nowhere": 2, "entity unused": 1, "relation without support": 3, "support without relation": 1,
    }
