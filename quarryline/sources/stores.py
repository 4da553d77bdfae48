"""Manifests, registries and settings that live in JSON files."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model


def read_manifest(spark: SparkSession, path: str, codebase_id: str) -> DataFrame:
    """The manifest rows of a JSON file {version, files: {path: {sha256, size, mtime_ns}}}; none where it is missing."""
    if not os.path.exists(path):
        return spark.createDataFrame([], model.MANIFEST)
    state = spark.read.schema(model.MANIFEST_JSON).option("multiLine", True).json(path)
    return state.select(F.explode("files").alias("relative_path", "s")).select(
        F.lit(codebase_id).alias("codebase_id"), "relative_path", "s.sha256", "s.size", "s.mtime_ns"
    )


def write_manifest(manifest: DataFrame, path: str, last_sync: str = "") -> None:
    """One JSON object of all rows, streamed from the executors and replaced at once."""
    temporary = f"{path}.tmp"
    with open(temporary, "w", encoding="utf-8") as file:
        file.write('{"version": 1, "last_sync": ' + json.dumps(last_sync) + ', "files": {')
        first = True
        for r in manifest.select("relative_path", "sha256", "size", "mtime_ns").toLocalIterator():
            file.write(("" if first else ",\n") + f"{json.dumps(r[0])}: " + json.dumps({"sha256": r[1], "size": r[2], "mtime_ns": r[3]}))
            first = False
        file.write("}}")
    os.replace(temporary, path)


def registry_of(text: Column) -> Column:
    """A registry's JSON as map collection -> (codebase_id, languages), from its present or its older form; null where it is neither."""
    now = F.from_json(text, model.REGISTRY_META)
    old = F.transform_values(
        F.from_json(text, model.REGISTRY_LEGACY),
        lambda _, v: F.struct(v.alias("codebase_id"), F.lit(None).cast("map<string,bigint>").alias("languages")),
    )
    valid = F.exists(F.map_values(now), lambda v: v["codebase_id"].isNotNull())
    return F.when(valid, now).otherwise(old)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(collection, codebase_id, languages) of a registry file; none where it is missing or broken."""
    schema = "collection string, codebase_id string, languages map<string,bigint>"
    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(registry_of(F.col("value"))).alias("collection", "m")).select("collection", "m.codebase_id", "m.languages")


def write_registry(rows: DataFrame, path: str) -> bool:
    """Writes (collection, codebase_id, languages) by way of a temporary file; false where nothing changed."""
    text = json.dumps({r.collection: {"codebase_id": r.codebase_id, "languages": r.languages or {}} for r in rows.orderBy("collection").toLocalIterator()}, indent=2)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            if file.read() == text:
                return False
    with open(path + ".tmp", "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(path + ".tmp", path)
    return True


def derived_id(root: str) -> str:
    """Folder name and short hash of its absolute path."""
    root = os.path.abspath(root)
    return f"{os.path.basename(root)}-{hashlib.sha256(root.encode()).hexdigest()[:8]}"


def load_project(root: str, tool_dir: str = ".quarryline") -> dict:
    """The project's settings (codebase_id, base_url); made and saved where there are none."""
    path = os.path.join(root, tool_dir, "config.json")
    try:
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
    except (OSError, ValueError):
        settings = {}
    if not settings.get("codebase_id"):
        settings = {"codebase_id": derived_id(root), "base_url": settings.get("base_url", "")}
        save_settings(path, settings)
    return settings


def save_settings(path: str, settings: dict) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(settings, file, indent=2)


def machine_base_url(path: str) -> str:
    """The base URL of a per-user settings file; empty where there is none."""
    try:
        with open(path, encoding="utf-8") as file:
            return json.load(file).get("base_url", "")
    except (OSError, ValueError):
        return ""
