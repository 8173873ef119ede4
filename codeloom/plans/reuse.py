"""Saved builds and when they can stand for a new one (rows R11, R12, T5)."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import codeloom
from codeloom.operators.graph import Graph
from codeloom.sources.graph_json import read_manifest

#: The form of manifests; another one is not compared.
MANIFEST_VERSION = 1

#: Refused for this alone, what was read in unchanged files can still be used.
NEWER = "files are newer than the graph"

_PACKAGE = Path(codeloom.__path__[0])


def fingerprint() -> str:
    """What the extractors are: a digest of their source. A build by other extractors is never reused."""
    digest = hashlib.sha256()
    for path in sorted((_PACKAGE / "sources").glob("*.py")):
        digest.update(path.name.encode() + b"\0" + path.read_bytes())
    return digest.hexdigest()


def code_changed_at() -> float:
    """When the package's code was last written."""
    return max(p.stat().st_mtime for p in _PACKAGE.rglob("*.py"))


@dataclass(frozen=True)
class Saved:
    """The last build of a repository; ``written`` is when its graph was (seconds since 1970), None if that is not known."""

    graph: Graph
    manifest: DataFrame
    version: int = MANIFEST_VERSION
    fingerprint: str = ""
    written: float | None = None
    #: What the extractors read in each file, so that only changed files are read again.
    rows: DataFrame | None = None


def write_build(graph: Graph, manifest: DataFrame, folder: str, rows: DataFrame | None = None) -> None:
    """The graph's, the manifest's and the extracted rows' tables and a head with their version and fingerprint, which is written last."""
    if rows is not None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows")
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{folder}/edges")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    head = {"version": MANIFEST_VERSION, "fingerprint": fingerprint()}
    with open(f"{folder}/head.json.tmp", "w", encoding="utf-8") as f:
        json.dump(head, f)
    os.replace(f"{folder}/head.json.tmp", f"{folder}/head.json")


def read_build(spark: SparkSession, folder: str) -> Saved | None:
    """The build that ``write_build`` left in ``folder``; None if there is none, if its head is empty or broken, or a table cannot be read."""
    head_path = os.path.join(folder, "head.json")
    try:
        if not os.path.isfile(head_path) or not os.path.getsize(head_path):
            return None
        with open(head_path, encoding="utf-8") as f:
            head = json.load(f)
        graph = Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))
        rows = spark.read.parquet(f"{folder}/rows") if os.path.isdir(f"{folder}/rows") else None
        return Saved(graph, spark.read.parquet(f"{folder}/manifest"), int(head["version"]), str(head["fingerprint"]), os.path.getmtime(head_path), rows)
    except Exception:  # noqa: BLE001  a build that cannot be read is made again
        return None


def read_document_build(spark: SparkSession, graph: Graph, manifest_path: str, written: float | None = None) -> Saved:
    """A build kept as documents: version and fingerprint stand in the manifest's head."""
    head = spark.read.schema("version int, fingerprint string").option("multiLine", True).json(manifest_path).first()
    return Saved(graph, read_manifest(spark, manifest_path), (head.version if head else None) or 0, (head.fingerprint if head else None) or "", written)


def refusal(saved: Saved | None, filtered: bool, files: DataFrame) -> str:
    """Why ``saved`` cannot stand for a build of ``files(mod_time)``, or an empty text; which files changed is decided after this.

    Refused: no saved build; filters that ask for another graph; another form of manifest; other extractors; files or code
    written after the graph was.
    """
    if saved is None:
        return "nothing saved"
    if filtered:
        return "filters ask for another graph"
    if saved.version != MANIFEST_VERSION:
        return "the manifest has another form"
    if saved.fingerprint != fingerprint():
        return "the extractors are others"
    if saved.written is not None:
        if code_changed_at() > saved.written:
            return "the code is newer than the graph"
        latest = files.agg(F.max("mod_time")).first()[0] if "mod_time" in files.columns else None
        if isinstance(latest, datetime) and latest.timestamp() > saved.written:
            return NEWER
    return ""
