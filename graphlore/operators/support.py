"""Relations kept by support: every article that states a relation is a reason for it, and it lives while it has one.

Support is (article, source, target, relation, context), each once. The view
of live relations is maintained by counts: a delta withdraws the support of
the articles that it changes or removes and adds what they state now; only
relations whose support was touched are counted anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlore.functions.columns import strip

RELATION = ["source", "target", "relation", "context"]
SUPPORT = ["article", *RELATION]


def supported(stated: DataFrame) -> DataFrame:
    """Support of what articles state: ends trimmed, null contexts empty, statements without an end left out, each once."""
    ends = [strip(F.col(c)).alias(c) for c in ("source", "target")]
    rows = stated.select("article", *ends, "relation", F.coalesce("context", F.lit("")).alias("context"))
    return rows.filter("source <> '' and target <> ''").distinct()


def counts(support: DataFrame) -> DataFrame:
    """How many articles state each relation."""
    return support.groupBy(*RELATION).agg(F.count(F.lit(1)).alias("n"))


def _moved(live: DataFrame, support: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Every relation with ``was`` and ``by``, by how much a delta changes it; null where it doesn't touch it.

    Live relations and moves are summed in one grouping: ``live``, ``support`` and ``fresh`` are each read once.
    """
    number = lambda x: F.lit(x).cast("bigint")
    withdrawn = support.join(changed.select("article").distinct(), "article", "left_semi").select(*RELATION, number(0).alias("was"), number(-1).alias("by"))
    rows = live.select(*RELATION, F.col("n").alias("was"), number(None).alias("by")).unionByName(withdrawn).unionByName(fresh.select(*RELATION, number(0).alias("was"), number(1).alias("by")))
    return rows.groupBy(*RELATION).agg(F.sum("was").alias("was"), F.sum("by").alias("by"))


def changes(live: DataFrame, support: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Relations that a delta touches, with ``was`` and ``now``.

    ``live``: relations with ``n``; ``changed``: titles (``article``) that are
    changed or removed; ``fresh``: the support that changed and new articles
    give.
    """
    return _moved(live, support, changed, fresh).filter("by is not null").select(*RELATION, "was", (F.col("was") + F.col("by")).alias("now"))


def applied(live: DataFrame, support: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """:func:`maintained` of the :func:`changes` of a delta, in one grouping: live relations after it, with ``n``."""
    n = F.col("was") + F.coalesce("by", F.lit(0))
    return _moved(live, support, changed, fresh).select(*RELATION, n.alias("n")).filter("n > 0")


def maintained(live: DataFrame, touched: DataFrame) -> DataFrame:
    """Live relations after a delta: those it did not touch as they were, and those that still or newly have support."""
    kept = live.join(touched.select(*RELATION), RELATION, "left_anti")
    return kept.select(*RELATION, "n").unionByName(touched.filter("now > 0").select(*RELATION, F.col("now").alias("n")))


def support_after(support: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    return support.join(changed.select("article").distinct(), "article", "left_anti").select(*SUPPORT).unionByName(fresh.select(*SUPPORT))


def unlike_support(live: DataFrame, support: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations without support, supported relations that are not live)."""
    a, b = live.select(*RELATION), support.select(*RELATION).distinct()
    return a.exceptAll(b), b.exceptAll(a)


def compared(live: DataFrame, support: DataFrame) -> DataFrame:
    """Every relation with ``live``, the rows that it has, and ``stated``, 1 if it has support: both tables meet in one grouping."""
    rows = live.select(*RELATION, F.lit(1).alias("live"), F.lit(0).alias("stated")).unionByName(support.select(*RELATION, F.lit(0).alias("live"), F.lit(1).alias("stated")))
    return rows.groupBy(*RELATION).agg(F.sum("live").alias("live"), F.max("stated").alias("stated"))


# validation ----------------------------------------------------------------------------------------

def _sum(value: Column | str, where: Column | None = None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0)).cast("bigint")


def _tally(rows: dict[str, Column]) -> list[Column]:
    return [F.struct(F.lit(name).alias("check_name"), n.alias("violations")) for name, n in rows.items()]


def _checks(df: DataFrame, found: dict[str, Column]) -> DataFrame:
    """check_name, violations: all sums over ``df`` in one pass."""
    return df.agg(F.array(*_tally(found)).alias("found")).select(F.explode("found").alias("x")).select("x.*")


def _met(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """Full outer join of grouped tables, each with a flag of its name; a null key meets nothing."""
    flagged = [df.withColumn(name, F.lit(True)) for name, df in sides.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), flagged)


def validate(
    article: DataFrame, section: DataFrame, links: DataFrame, has_entity: DataFrame, entity: DataFrame, relation: DataFrame, size: int = 768, derived: dict[str, tuple[DataFrame, DataFrame, str]] | None = None,
    support: DataFrame | None = None, source: DataFrame | None = None, chunk: DataFrame | None = None, applied: DataFrame | None = None,
) -> DataFrame:
    """check_name, violations: every referential and content check of a pack; a valid one has none.

    Each table is grouped by the keys it is checked by and the groups meet in
    one full join for each kind of key, so that a table is read once for each
    key and not once for each check. ``derived``: by name (stored, derived,
    key), such as articles beside what their payloads give anew.

    Further tables, where a pack has them: ``support`` (article, source,
    target, relation, context), ``source`` (title, payload, hash), ``chunk``
    (id, article, section_index, chunk_index, content), ``applied`` (title,
    hash of the payload that a delta left).
    """
    from graphlore.operators.incremental import differing

    n = F.count(F.lit(1)).alias("n")
    blank = lambda c: F.coalesce(strip(F.col(c).cast("string")) == "", F.lit(True))
    v = F.col("embedding")
    sound = v.isNotNull() & (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    mentions = has_entity.groupBy("article", "entity_id").agg(n)
    places = section.groupBy(F.col("article").alias("key")).agg(
        F.count(F.lit(1)).alias("n_s"), F.min("section_index").alias("low"), F.max("section_index").alias("high"), F.countDistinct("section_index").alias("d"),
        F.count_if(~sound).alias("unsound"), F.count_if(blank("content")).alias("empty"))
    titles = article.groupBy(F.col("title").alias("key")).agg(F.count(F.lit(1)).alias("n_a"), F.count_if(blank("title")).alias("untitled"))
    by_title = {"is_a": titles, "is_s": places, "is_m": mentions.groupBy(F.col("article").alias("key")).agg(F.sum("n").alias("n_m"))}
    a, s, m = F.col("is_a").isNotNull(), F.col("is_s").isNotNull(), F.col("is_m").isNotNull()
    found = {
        "article title repeated": _sum(F.lit(1), F.col("n_a") > 1), "section without article": _sum("n_s", s & ~a), "article without section": _sum("n_a", a & ~s),
        "mention in no article": _sum("n_m", m & ~a), "embedding unsound": _sum("unsound"), "article without title": _sum("untitled"), "section without content": _sum("empty"),
        "sections not numbered from 0": _sum(F.lit(1), s & ((F.col("low") != 0) | (F.col("high") != F.col("n_s") - 1) | (F.col("d") != F.col("n_s")))),
    }
    more: list[DataFrame] = []
    if support is not None:
        by_title["is_p"] = support.groupBy(F.col("article").alias("key")).agg(F.count(F.lit(1)).alias("n_p"))
        found["support of no article"] = _sum("n_p", F.col("is_p") & ~a)
        more += [
            _checks(support.groupBy(*SUPPORT).agg(n), {"support repeated": _sum(F.lit(1), F.col("n") > 1)}),
            _checks(compared(relation, support), {"relation without support": _sum(F.greatest(F.col("live") - F.col("stated"), F.lit(0))), "support without relation": _sum("stated", F.col("live") == 0)}),
        ]
    if source is not None:
        whole = source.groupBy(F.col("title").alias("key")).agg(F.count(F.lit(1)).alias("n_o"), F.count_if(~F.coalesce(F.sha2("payload", 256) == F.col("hash"), F.lit(False))).alias("changed"), F.min("hash").alias("source_hash"))
        by_title["is_o"] = whole
        found |= {"source repeated": _sum(F.lit(1), F.col("n_o") > 1), "source unlike its hash": _sum("changed"), "source of no article": _sum("n_o", F.col("is_o") & ~a), "article without source": _sum("n_a", a & F.col("is_o").isNull())}
        if applied is not None:
            by_title["is_d"] = applied.groupBy(F.col("title").alias("key")).agg(F.min("hash").alias("applied_hash"), F.count(F.lit(1)).alias("n_d"))
            found["applied delta unlike its source"] = _sum("n_d", F.col("is_d") & ~F.col("applied_hash").eqNullSafe(F.col("source_hash")))
    if chunk is not None:
        pieces = chunk.groupBy("article", "section_index").agg(F.count(F.lit(1)).alias("n_c"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"), F.countDistinct("chunk_index").alias("d"), F.count_if(blank("content")).alias("empty"))
        known = section.select("article", "section_index").distinct().withColumn("is_s", F.lit(True))
        of_section = pieces.join(known, ["article", "section_index"], "left")
        more += [
            _checks(of_section, {"chunk without section": _sum("n_c", F.col("is_s").isNull()), "chunk without content": _sum("empty"), "chunks not numbered from 0": _sum(F.lit(1), (F.col("low") != 0) | (F.col("high") != F.col("n_c") - 1) | (F.col("d") != F.col("n_c")))}),
            _checks(chunk.groupBy("id").agg(n), {"chunk id repeated": _sum(F.lit(1), F.col("n") > 1)}),
        ]

    related = relation.groupBy("source", "target", "relation").agg(n)
    ends = related.select("n", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("source").alias("key")), F.struct(F.lit(False).alias("first"), F.col("target").alias("key")))).alias("e")).select("n", "e.*")
    of_entity = {
        "is_e": entity.groupBy(F.col("entity_id").alias("key")).agg(F.count(F.lit(1)).alias("n_e")), "is_m": mentions.groupBy(F.col("entity_id").alias("key")).agg(F.sum("n").alias("n_m")),
        "is_r": ends.groupBy("key").agg(_sum("n", F.col("first")).alias("n_from"), _sum("n", ~F.col("first")).alias("n_to")),
    }
    e, r = F.col("is_e").isNotNull(), F.col("is_r").isNotNull()
    of_entities = {
        "entity id repeated": _sum(F.lit(1), F.col("n_e") > 1), "mention of no entity": _sum("n_m", m & ~e), "relation from nowhere": _sum("n_from", r & ~e), "relation to nowhere": _sum("n_to", r & ~e),
        "entity unused": _sum("n_e", e & ~m & ~r),
    }
    linked = links.groupBy("src", "dst").agg(n)
    tips = linked.select("n", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("src").alias("key")), F.struct(F.lit(False).alias("first"), F.col("dst").alias("key")))).alias("e")).select("n", "e.*")
    of_section = {"is_s": section.groupBy(F.col("id").alias("key")).agg(F.count(F.lit(1)).alias("n_s")), "is_l": tips.groupBy("key").agg(_sum("n", F.col("first")).alias("n_from"), _sum("n", ~F.col("first")).alias("n_to"))}
    lone = F.col("is_l") & F.col("is_s").isNull()
    checks = [
        _checks(_met(by_title, "key"), found), _checks(_met(of_entity, "key"), of_entities),
        _checks(_met(of_section, "key"), {"section id repeated": _sum(F.lit(1), F.col("n_s") > 1), "link from nowhere": _sum("n_from", lone), "link to nowhere": _sum("n_to", lone)}),
        _checks(linked, {"link repeated": _sum(F.lit(1), F.col("n") > 1), "link to itself": _sum("n", F.col("src") == F.col("dst"))}),
        _checks(mentions, {"mention repeated": _sum(F.lit(1), F.col("n") > 1)}), _checks(related, {"relation repeated": _sum(F.lit(1), F.col("n") > 1)}), *more,
        *(_checks(differing(*x), {f"{name} differs from its source": _sum(F.lit(1))}) for name, x in (derived or {}).items()),
    ]
    return reduce(DataFrame.unionByName, checks)
