"""Declared contracts (rows X17-X20, H14): OpenAPI documents and proto files as service and endpoint nodes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import Graph

METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
_SERVICE = re.compile(r"(?m)^\s*service\s+([A-Za-z_][A-Za-z0-9_]*)\s*\{")
_RPC = re.compile(r"(?m)^\s*rpc\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(")


def is_contract(path: Column) -> Column:
    """X20."""
    base = F.lower(F.substring_index(path, "/", -1))
    return base.endswith(".proto") | (base.rlike(r"\.(yaml|yml|json)$") & (base.contains("openapi") | base.contains("swagger")))


def _document(source: str):
    try:
        return json.loads(source)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError:
        return _simple_yaml(source)
    try:
        return yaml.safe_load(source)
    except yaml.YAMLError:
        return None


def _simple_yaml(source: str) -> dict:
    """Nested mappings by indentation, scalars as text; enough for the keys read here where no YAML reader is installed."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for line in source.splitlines():
        m = re.match(r"^(\s*)(\"[^\"]*\"|'[^']*'|[^\s#'\"][^:]*?|/[^:]*?):(?:\s+(.*))?$", line)
        if not m:
            continue
        depth, key, value = len(m.group(1)), m.group(2).strip("\"'"), (m.group(3) or "").strip()
        while stack[-1][0] >= depth:
            stack.pop()
        if value and not value.startswith("#"):
            stack[-1][1][key] = value.strip("\"'")
        else:
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
    return root


def openapi_rows(source: str, path: str) -> list[tuple]:
    """(kind, id, label, parent, description); the title falls back to the file's name."""
    doc = _document(source)
    if not isinstance(doc, dict) or not (doc.get("openapi") or doc.get("swagger")):
        return []
    info = doc.get("info") if isinstance(doc.get("info"), dict) else {}
    title = str(info.get("title") or "").strip() or re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    service = f"contract:service:{title.lower()}"
    rows = [("service", service, title, "", f'Declared service "{title}" (OpenAPI)')]
    paths = doc.get("paths") if isinstance(doc.get("paths"), dict) else {}
    for p in sorted(paths):
        for m in sorted(x for x in (paths[p] or {}) if str(x).lower() in METHODS):
            rows.append(("contract", f"contract:endpoint:{title.lower()}:{m.lower()}:{p}", f"{m.upper()} {p}", service, "Declared endpoint"))
    return rows


def proto_rows(source: str) -> list[tuple]:
    """A service's body reaches to the next service."""
    rows = []
    found = list(_SERVICE.finditer(source))
    for m, after in zip(found, [*found[1:], None], strict=True):
        name = m.group(1)
        service = f"contract:service:{name.lower()}"
        rows.append(("service", service, name, "", f'Declared service "{name}" (proto)'))
        for r in _RPC.findall(source[m.end() : after.start() if after else len(source)]):
            rows.append(("contract", f"contract:rpc:{name.lower()}:{r.lower()}", f"{name}.{r}", service, "Declared RPC"))
    return rows


def contracts(files: DataFrame, project_id: str) -> Graph:
    """Nodes, ``declares`` edges, and ``declared_in`` from each service to the project; all declared."""
    schema = "path string, kind string, id string, label string, parent string, description string, seq long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                source = (content or b"").decode("utf-8", "replace")
                found = proto_rows(source) if path.lower().endswith(".proto") else openapi_rows(source, path)
                out += [(path, *r, k) for k, r in enumerate(found)]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string()] * 6 + [pa.int64()], strict=True)], names=["path", "kind", "id", "label", "parent", "description", "seq"])

    rows = files.where(is_contract(F.col("path"))).select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)
    kind = F.when(F.lower("path").endswith(".proto"), "proto").otherwise("openapi")
    nodes = rows.select("id", "label", "kind", F.col("path").alias("file"), "description", F.lit("contract").alias("layer"), kind.alias("evidence_type"), F.lit("declared").alias("evidence_confidence"), F.lit("").alias("source_name"), F.col("seq").alias("ord"))
    declares = rows.where("parent <> ''").select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("declares").alias("relation"), F.col("path").alias("file"), F.col("seq").alias("ord"))
    bound = rows.where("kind = 'service'").select(F.col("id").alias("src"), F.lit(project_id).alias("dst"), F.lit("declared_in").alias("relation"), F.col("path").alias("file"), F.col("seq").alias("ord"))
    edges = declares.unionByName(bound).withColumns({"confidence": F.lit("DECLARED"), "score": F.lit(0.0), "layer": F.lit("contract"), "evidence_confidence": F.lit("declared")})
    return Graph(nodes, edges)
