"""Semantic versions and dated tags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The public grammar of semantic versions; fixed values.
_NUMBER = r"(?:0|[1-9]\d*)"
_PRE = rf"(?:{_NUMBER}|\d*[a-zA-Z-][0-9a-zA-Z-]*)"
SEMVER = re.compile(rf"^({_NUMBER})\.({_NUMBER})\.({_NUMBER})(?:-({_PRE}(?:\.{_PRE})*))?(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?$")
PATTERN = SEMVER.pattern


def valid(version: Column) -> Column:
    return F.coalesce(version.rlike(PATTERN), F.lit(False))


def order_key(version: Column) -> Column:
    """A value that sorts as versions do: numbers by length, then digits; a release after its pre-releases; build ignored."""
    part = lambda k: F.regexp_extract(version, PATTERN, k)
    number = lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))
    ids = F.when(part(4) == "", F.array().cast("array<string>")).otherwise(F.split(part(4), r"\."))
    keyed = F.transform(ids, lambda x: F.when(x.rlike(r"^\d+$"), F.struct(F.lit(0).alias("kind"), F.length(x).alias("n"), x.alias("x"))).otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("n"), x.alias("x"))))
    return F.when(valid(version), F.struct(*[number(part(k)).alias(f"p{k}") for k in (1, 2, 3)], (part(4) == "").alias("release"), keyed.alias("pre")))


def key(version: str) -> tuple:
    """The same order for one version on the driver."""
    m = SEMVER.match(version)
    if not m:
        raise ValueError(f"not a semantic version: {version!r}")
    pre = tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in m[4].split(".")) if m[4] else ()
    return (*(int(m[k]) for k in (1, 2, 3)), not m[4], pre)


def dated(tag: Column) -> Column:
    """``name-YYYY.MM[.N]`` as a version without leading zeros; null for other tags."""
    pattern = r"-(\d{4})\.(\d{2})(?:\.(\d+))?$"
    part = lambda k: F.regexp_extract(tag, pattern, k)
    month = part(2).try_cast("int")
    last = F.when(part(3) == "", F.lit("0")).otherwise(part(3).try_cast("bigint").cast("string"))
    return F.when(month.between(1, 12), F.concat_ws(".", part(1), month.cast("string"), last))
