"""Manifests of packs: reading, checking and writing them."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import SparkSession

from graphlore.functions.versions import SEMVER
from graphlore.operators.records import FORBIDDEN, safe_json

NAME = re.compile(r"^[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}$")
FILE = "manifest.json"


class ManifestError(ValueError):
    """A manifest that does not hold what it must."""


def _numbers(value: object, where: str, least: float | None) -> None:
    if not isinstance(value, dict):
        raise ManifestError(f"{where} is not an object")
    for k, n in value.items():
        if isinstance(n, bool) or not isinstance(n, (int, float)) or not math.isfinite(n) or (least is not None and n < least):
            raise ManifestError(f"{where}.{k} is no fitting number")


def validate(manifest: object) -> dict:
    """The manifest without dangerous keys; a section that is null counts as absent, unknown ones are kept."""
    if not isinstance(manifest, dict):
        raise ManifestError("a manifest is a JSON object")
    if not isinstance(manifest.get("name"), str) or not NAME.match(manifest["name"]):
        raise ManifestError(f"bad name {manifest.get('name')!r}")
    if not isinstance(manifest.get("version"), str) or not SEMVER.match(manifest["version"]):
        raise ManifestError(f"bad version {manifest.get('version')!r}")
    if not isinstance(manifest.get("description", ""), str):
        raise ManifestError("the description is not a text")
    if manifest.get("graph_stats") is not None:
        _numbers(manifest["graph_stats"], "graph_stats", 0)
    if manifest.get("eval_scores") is not None:
        _numbers(manifest["eval_scores"], "eval_scores", None)
    return {k: v for k, v in manifest.items() if k not in FORBIDDEN}


def load(spark: SparkSession, folder: str) -> dict:
    """The manifest of a pack's folder, wherever Spark can read it."""
    rows = spark.read.text(f"{folder}/{FILE}", wholetext=True).collect()
    try:
        return validate(safe_json(rows[0].value))
    except (IndexError, json.JSONDecodeError) as e:
        raise ManifestError(f"no manifest can be read in {folder}") from e


def save(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Write a manifest beside a pack's tables, under a temporary name first."""
    text = json.dumps(validate(manifest), indent=2, ensure_ascii=False)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, staging = jvm.org.apache.hadoop.fs.Path(f"{folder}/{FILE}"), jvm.org.apache.hadoop.fs.Path(f"{folder}/.{FILE}.new")
    fs = target.getFileSystem(conf)
    out = fs.create(staging, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(staging, target)
