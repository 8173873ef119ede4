"""Small records beside graphs: the registry of repositories, the cache of hashes, the history of benchmarks (rows K10, H30, S20).

A registry has a row for each repository and a history one for each run, so documents of them are written by the driver.
"""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.manifest import upsert
from codeloom.sources.graph_json import read_registry

REGISTRY = "repo_root string, name string, remote string, graph_path string, manifest_path string, report_path string, updated_at timestamp"
_STAMP = "%Y-%m-%dT%H:%M:%SZ"


def _replaced(path: str, value) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2)
        f.write("\n")
    os.replace(f"{path}.tmp", path)


def registry_rows(rows: DataFrame) -> DataFrame:
    """Texts trimmed, roots absolute without a closing slash, the name after the root where it is blank; rows without a root go."""
    trimmed = rows.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    root = F.regexp_replace(F.regexp_replace("repo_root", "/(?:\\./)+|/{2,}", "/"), "(?<=.)/+$", "")
    clean = trimmed.where("repo_root <> ''").withColumn("repo_root", root)
    return clean.withColumn("name", F.when(F.col("name") == "", F.substring_index("repo_root", "/", -1)).otherwise(F.col("name")))


def write_registry(rows: DataFrame, path: str) -> None:
    """The registry as a document, by name, then root; null times are left out."""
    entries = []
    for r in registry_rows(rows).orderBy("name", "repo_root").toLocalIterator():
        entry = {k: v for k, v in r.asDict().items() if k != "updated_at"}
        if r.updated_at is not None:
            entry["updated_at"] = r.updated_at.astimezone(UTC).strftime(_STAMP)
        entries.append(entry)
    _replaced(path, {"version": 1, "entries": entries})


def track(spark: SparkSession, path: str, repo_root: str, name: str, remote: str, graph_path: str, report_path: str = "") -> None:
    """Puts one repository in the registry at ``path``, in place of the row of its root; a missing registry is empty."""
    if not repo_root.strip():
        raise ValueError("a repository needs a root")
    manifest_path = os.path.join(os.path.dirname(graph_path.strip()), "manifest.json")
    row = spark.createDataFrame([(os.path.abspath(repo_root.strip()), name, remote, graph_path.strip(), manifest_path, report_path.strip(), datetime.now(UTC))], REGISTRY)
    rows = registry_rows(row)
    if os.path.exists(path):
        known = read_registry(spark, path).select(*rows.columns)
        # read before its file is replaced: a handful of rows
        rows = upsert(spark.createDataFrame(known.collect(), REGISTRY), rows, ["repo_root"])
    write_registry(rows, path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of a cache document; a missing or broken one is empty."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        rows = [(k, v) for k, v in held.items() if isinstance(v, str)]
    except (OSError, ValueError, AttributeError):
        rows = []
    return spark.createDataFrame(rows, "path string, sha256 string")


def write_cache(cache: DataFrame, path: str) -> None:
    """(path, sha256) as one object; the later of a repeated path stands."""
    _replaced(path, {r.path: r.sha256 for r in cache.select("path", "sha256").orderBy("path", "sha256").toLocalIterator()})


def write_history(metrics: DataFrame, folder: str, at: datetime | None = None) -> str:
    """One row of metrics as a new file of ``folder``, named after its time; a taken name gets a number. Returns the path."""
    base = os.path.join(folder, f"bench-{(at or datetime.now(UTC)).astimezone(UTC):%Y%m%dT%H%M%SZ}")
    path, k = f"{base}.json", 0
    while os.path.exists(path):
        k += 1
        path = f"{base}-{k}.json"
    row = metrics.select(F.to_json(F.struct("*")).alias("json")).first()
    _replaced(path, json.loads(row.json) if row else {})
    return path


def last_history(folder: str) -> str | None:
    """The latest file of ``write_history``: by time, then by number; None if there is none."""
    if not os.path.isdir(folder):
        return None
    names = [n for n in os.listdir(folder) if n.startswith("bench-") and n.endswith(".json")]

    def order(name: str) -> tuple[str, int]:
        stamp, _, number = name[len("bench-") : -len(".json")].partition("-")
        return stamp, int(number) if number.isdigit() else 0

    return os.path.join(folder, max(names, key=order)) if names else None
