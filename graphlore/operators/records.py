"""Structured vulnerability records and model extractions as articles, entities and relations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlore.functions.columns import strip
from graphlore.functions.text import relation, strip_fence

#: The part of a record that is read.
RECORD = """struct<
  cveMetadata: struct<cveId: string, state: string, assignerShortName: string, datePublished: string>,
  containers: struct<
    cna: struct<title: string, descriptions: array<struct<lang: string, value: string>>,
      affected: array<struct<vendor: string, product: string, packageName: string, collectionURL: string, repo: string, purl: string, modules: array<string>, cpes: array<string>, purls: array<string>>>,
      problemTypes: array<struct<descriptions: array<struct<cweId: string, description: string>>>>,
      metrics: array<struct<cvssV4_0: struct<baseScore: double, baseSeverity: string, vectorString: string>, cvssV3_1: struct<baseScore: double, baseSeverity: string, vectorString: string>,
        cvssV3_0: struct<baseScore: double, baseSeverity: string, vectorString: string>, cvssV2_0: struct<baseScore: double, baseSeverity: string, vectorString: string>, other: struct<content: struct<other: string>>>>>,
    adp: array<struct<problemTypes: array<struct<descriptions: array<struct<cweId: string, description: string>>>>,
      metrics: array<struct<cvssV4_0: struct<baseScore: double, baseSeverity: string, vectorString: string>, cvssV3_1: struct<baseScore: double, baseSeverity: string, vectorString: string>,
        cvssV3_0: struct<baseScore: double, baseSeverity: string, vectorString: string>, cvssV2_0: struct<baseScore: double, baseSeverity: string, vectorString: string>, other: struct<content: struct<other: string>>>>>>>>""".replace("\n", " ")

#: Hosts of package registries and their ecosystems, tried in this order; fixed values.
REGISTRIES = (
    (r"(^|\.)npmjs\.(org|com)", "npm"), (r"(^|\.)pypi\.org", "pypi"), (r"(^|\.)rubygems\.org", "gem"), (r"(^|\.)crates\.io", "cargo"),
    (r"(^|\.)nuget\.org", "nuget"), (r"(^|\.)packagist\.org", "composer"), (r"maven|repo1\.maven", "maven"), (r"golang|code\.gitea\.io|gopkg\.in|proxy\.golang", "go"),
)
SUMMARY = 1500


def _t(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def _real(c: Column) -> Column:
    return (_t(c) != "") & (F.lower(_t(c)) != "n/a")


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array())


def _unique(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda x: x != ""))


#: What is not the name in a package's address, taken off in this order; fixed values.
AROUND = (r"(?i)^[a-z][\w+.-]*://", r"(?i)^git\+", r"(?i)\.git$", r"/+$")


def _bare(c: Column) -> Column:
    for pattern in AROUND:
        c = F.regexp_replace(c, pattern, "")
    return c


def _ecosystem(url: Column) -> Column:
    host, out = F.lower(_bare(_t(url))), F.lit("")
    for pattern, name in reversed(REGISTRIES):
        out = F.when(host.rlike(pattern), name).otherwise(out)
    return out


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row for each publishable record: article, section, entities, relations. Rejected, unnamed and undescribed records are left out."""
    r = lines.select(F.from_json(column, RECORD).alias("r")).select("r.cveMetadata", "r.containers")
    meta, cna = F.col("cveMetadata"), F.col("containers.cna")
    # fields that later columns use many times become columns first
    rows = r.select(
        _t(meta["cveId"]).alias("id"), F.upper(_t(meta["state"])).alias("state"), F.substring(_t(meta["datePublished"]), 1, 10).alias("published"), _t(meta["assignerShortName"]).alias("assigner"),
        _t(cna["title"]).alias("heading"), cna["descriptions"].alias("descriptions"), F.coalesce(cna["affected"], F.from_json(F.lit("[]"), "array<struct<vendor: string, product: string, packageName: string, collectionURL: string, repo: string, purl: string, modules: array<string>, cpes: array<string>, purls: array<string>>>")).alias("affected"),
        F.concat(F.array(cna["problemTypes"]), F.transform("containers.adp", lambda a: a["problemTypes"])).alias("kinds_all"),
        cna["problemTypes"].alias("kinds_own"),
        cna["metrics"].alias("metrics_own"), F.flatten(F.transform("containers.adp", lambda a: F.coalesce(a["metrics"], F.filter(a["metrics"], lambda x: F.lit(False))))).alias("metrics_adp"),
    )
    rows = rows.filter(F.col("id").rlike(r"^CVE-\d{4}-\d{4,19}$") & (F.col("state") != "REJECTED"))
    d = F.col("descriptions")
    english = F.get(F.filter(d, lambda x: F.startswith(F.lower(_t(x["lang"])), F.lit("en"))), F.lit(0))["value"]
    rows = rows.withColumn("description", F.when(F.exists(d, lambda x: F.startswith(F.lower(_t(x["lang"])), F.lit("en"))), _t(english)).otherwise(_t(F.get(d, F.lit(0))["value"]))).filter("description <> ''")

    kinds = F.flatten(F.filter(F.transform(F.flatten(F.filter(F.coalesce(F.col("kinds_all"), F.array(F.col("kinds_own"))), lambda k: k.isNotNull())), lambda p: p["descriptions"]), lambda x: x.isNotNull()))
    named = F.transform(kinds, lambda x: F.struct(_t(x["cweId"]).alias("id"), F.trim(F.regexp_replace(_t(x["description"]), r"(?i)^CWE-\d+\s*[:.-]?\s*", "")).alias("name")))
    rows = rows.withColumn("named", F.filter(named, lambda x: x["id"].rlike(r"^CWE-\d+$")))
    rows = rows.withColumn("cwes", F.filter("named", lambda x, k: F.array_position(F.transform("named", lambda y: y["id"]), x["id"]) == k + 1))

    cvss = lambda m: F.coalesce(m["cvssV4_0"], m["cvssV3_1"], m["cvssV3_0"], m["cvssV2_0"])
    both = F.concat(F.coalesce(F.col("metrics_own"), F.filter("metrics_adp", lambda x: F.lit(False))), F.coalesce(F.col("metrics_adp"), F.filter("metrics_own", lambda x: F.lit(False))))
    both = F.coalesce(both, F.col("metrics_own"), F.col("metrics_adp"))

    def grade(m: Column) -> Column:
        c = cvss(m)
        level, score = F.upper(_t(c["baseSeverity"])), c["baseScore"]
        number = F.when(score == F.floor(score), F.floor(score).cast("string")).otherwise(score.cast("string"))
        label = F.when((level != "") & score.isNotNull(), F.concat(level, F.lit(" (CVSS "), number, F.lit(")"))).when(level != "", level).when(score.isNotNull(), F.concat(F.lit("CVSS "), number)).otherwise("")
        scored = (level != "") | score.isNotNull() | (_t(c["vectorString"]) != "")
        return F.when(scored, F.concat_ws(" ", F.filter(F.array(label, _t(c["vectorString"])), lambda x: x != ""))).otherwise(_t(m["other"]["content"]["other"]))

    rows = rows.withColumn("severity", F.coalesce(F.get(F.filter(F.transform(both, grade), lambda g: g != ""), F.lit(0)), F.lit("")))

    a = F.col("affected")
    field = lambda f: _unique(F.transform(F.filter(a, lambda x: _real(x[f])), lambda x: _t(x[f])))
    many = lambda f: _unique(F.flatten(F.transform(a, lambda x: F.filter(F.transform(F.coalesce(x[f], F.array().cast("array<string>")), _t), _real))))
    sold = F.filter(F.transform(a, lambda x: F.struct(_t(x["vendor"]).alias("vendor"), _t(x["product"]).alias("product"))), lambda x: _real(x["product"]))
    purls = F.flatten(F.transform(a, lambda x: F.concat(F.array(_t(x["purl"])), F.transform(F.coalesce(x["purls"], F.array().cast("array<string>")), _t))))
    imports = F.flatten(F.transform(a, lambda x: F.when(_real(x["packageName"]) & F.contains(_t(x["packageName"]), F.lit("/")), F.array(_t(x["packageName"]))).when(_real(x["packageName"]) & _real(x["collectionURL"]), F.array(F.concat(_bare(_t(x["collectionURL"])), F.lit("/"), _t(x["packageName"])))).otherwise(F.array().cast("array<string>"))))
    rows = rows.withColumns({
        "sold": sold, "names": field("packageName"), "collections": field("collectionURL"), "modules": many("modules"), "cpes": many("cpes"),
        "purls": _unique(F.filter(purls, _real)), "repos": _unique(F.filter(F.transform(a, lambda x: _bare(_t(x["repo"]))), _real)), "imports": imports,
    })
    rows = rows.withColumns({
        "vendors": _unique(F.filter(F.transform("sold", lambda x: x["vendor"]), _real)), "products": _unique(F.transform("sold", lambda x: x["product"])),
        "aliases": _unique(F.concat("imports", "modules", "repos", F.transform("purls", lambda p: F.regexp_extract(p, r"(?i)^pkg:[^/]+/([^@?#]+)", 1)), "names")),
        "ecosystems": _unique(F.concat(F.transform("purls", lambda p: F.lower(F.regexp_extract(p, r"(?i)^pkg:([^/@]+)/", 1))), F.transform("collections", _ecosystem))),
    })
    joined = lambda c: F.array_join(c, "; ")
    some = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(head), joined(c), F.lit(".")))
    text = lambda c, head: F.when(F.col(c) != "", F.concat(F.lit(head), F.col(c), F.lit(".")))
    made_of = _unique(F.transform("sold", lambda x: F.array_join(F.filter(F.array(x["vendor"], x["product"]), _real), " ")))
    weak = F.transform("cwes", lambda x: F.when(x["name"] != "", F.concat_ws(" ", x["id"], x["name"])).otherwise(x["id"]))
    summary = F.when(F.length("description") > SUMMARY, F.concat(F.substring("description", 1, SUMMARY), F.lit("..."))).otherwise(F.col("description"))
    content = F.concat_ws("\n\n", F.when(F.col("heading") != "", F.col("heading")), summary, some(made_of, "Affected: "), some(_unique(F.concat("names", "collections", "purls")), "Package: "), some(F.col("aliases"), "Aliases: "), some(F.col("cpes"), "CPE: "), some(weak, "Weaknesses: "), text("severity", "Severity: "), text("published", "Published: "), text("assigner", "Assigner: "))
    entity = lambda name, kind, about: F.struct(name.alias("name"), F.lit(kind).alias("type"), about.alias("description"))
    about = F.when(F.col("heading") != "", F.col("heading")).otherwise(F.substring("description", 1, 200))
    entities = F.concat(F.array(entity(F.col("id"), "vulnerability", about)), F.transform("cwes", lambda x: entity(x["id"], "weakness", x["name"])), F.transform("vendors", lambda v: entity(v, "organization", F.lit("CVE-affected vendor"))), F.transform("products", lambda p: entity(p, "product", F.lit("CVE-affected product"))))
    link = lambda s, t, r, c: F.struct(s.alias("source"), t.alias("target"), F.lit(r).alias("relation"), c.alias("context"))
    links = F.concat(F.transform("cwes", lambda x: link(F.col("id"), x["id"], "has_weakness", x["name"])), F.flatten(F.transform("sold", lambda x: F.concat(F.array(link(F.col("id"), x["product"], "affects", F.col("heading"))), F.filter(F.array(link(x["product"], x["vendor"], "made_by", F.lit(""))), lambda y: _real(y["target"]))))))
    return rows.select(
        F.col("id").alias("article"), F.concat(F.lit("https://www.cve.org/CVERecord?id="), "id").alias("url"), F.get(F.split("id", "-"), F.lit(1)).alias("category"),
        F.concat("id", F.lit("#0")).alias("section_id"), F.when(F.col("heading") != "", F.col("heading")).otherwise(F.col("id")).alias("title"), content.alias("content"),
        joined(F.col("products")).alias("affected_products"), joined(F.col("aliases")).alias("aliases"), joined(F.col("cpes")).alias("cpes"), joined(F.col("purls")).alias("purls"), joined(F.col("ecosystems")).alias("ecosystems"),
        entities.alias("entities"), links.alias("relationships"),
    )


def parse_extraction(answers: DataFrame, column: str) -> DataFrame:
    """``answers`` with readable, entities, relationships and key_facts of a model's JSON; what is malformed in a list is left out."""
    v = F.try_parse_json(strip_fence(F.col(column)))
    rows = answers.withColumn("_v", v)
    got = lambda p: F.coalesce(F.try_variant_get("_v", p, "array<variant>"), F.array().cast("array<variant>"))
    s = lambda x, p: F.when(F.schema_of_variant(F.try_variant_get(x, p, "variant")) == "STRING", F.try_variant_get(x, p, "string"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    entities = F.transform(F.filter(got("$.entities"), lambda x: ~blank(s(x, "$.name"))), lambda x: F.struct(F.substring(s(x, "$.name"), 1, 256).alias("name"), F.when(blank(s(x, "$.type")), "concept").otherwise(F.trim(s(x, "$.type"))).alias("type"), F.coalesce(s(x, "$.description"), s(x, "$.properties")).alias("description")))
    verb = lambda x: F.coalesce(s(x, "$.relation"), s(x, "$.type"))
    whole = F.filter(got("$.relationships"), lambda x: ~blank(s(x, "$.source")) & ~blank(s(x, "$.target")) & ~blank(verb(x)))
    relations = F.transform(whole, lambda x: F.struct(F.trim(s(x, "$.source")).alias("source"), F.trim(s(x, "$.target")).alias("target"), relation(verb(x)).alias("relation"), s(x, "$.context").alias("context")))
    facts = F.filter(F.transform(got("$.key_facts"), lambda x: F.trim(F.coalesce(s(x, "$"), F.lit("")))), lambda f: f != "")
    rows = rows.withColumns({"readable": F.col("_v").isNotNull(), "entities": entities, "relationships": relations, "key_facts": F.transform(facts, lambda f: F.substring(f, 1, 1024))})
    return rows.drop("_v")


def canonical_json(value: object) -> str:
    """JSON with keys in the order of their code points and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


FORBIDDEN = ("__proto__", "constructor", "prototype")


def safe_json(text: str) -> object:
    """Parsed JSON; raises ``ValueError`` if it can't be read or has a forbidden key anywhere."""
    def check(pairs: list) -> dict:
        if any(k in FORBIDDEN for k, _ in pairs):
            raise ValueError("the JSON has a forbidden key")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=check)
