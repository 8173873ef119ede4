"""Graph, manifest and registry documents (rows S1-S4, S13, S14, S20, F13)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.graph import Graph

from .line_document import in_lines, lines

NODE = "id string, label string, kind string, file string, description string, source_id string, source_type string, source_name string, source_organization string, source_path string, source_remote string, community int, metadata string"
EDGE = "`from` string, `to` string, kind string, file string, confidence string, score double, metadata string"
DOCUMENT = f"nodes array<struct<{NODE.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>, edges array<struct<{EDGE.replace(' string', ':string').replace(' double', ':double')}>>"

#: Metadata of edges that operators read back.
EDGE_METADATA = {
    "layer": "layer", "evidence_type": "evidence_type", "evidence_confidence": "evidence_confidence", "evidence_artifact": "evidence_source_artifact", "verification": "verification", "projected_from": "projected_from",
    "reference_target": "reference_target", "bound_target": "bound_target", "binding_state": "binding_state", "binding_evidence": "binding_evidence",
}


def read_graph(spark: SparkSession, path: str, canonical: bool = True) -> Graph:
    """S2 (S3 with ``canonical`` off): the graph of a document, or of several with earlier paths first. Missing, empty and zero are equal.

    Positions in the document become ord. A document with a row a line, as ``write_json`` makes them, is read in ranges of bytes;
    any other is one JSON value and so one task's.
    """
    if in_lines(path):
        # as rows of a generator, so that no filter is pushed below it, which would parse each line again for each condition
        n, e = (lines(spark, path, s).select("ord", F.inline(F.array(F.from_json("json", row)))) for s, row in (("nodes", NODE), ("edges", EDGE)))
        return _graph(n, e, canonical)
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("__file", F.input_file_name())
    n = doc.select("__file", F.posexplode("nodes").alias("ord", "n")).select("__file", F.col("ord").cast("long").alias("ord"), "n.*")
    e = doc.select("__file", F.posexplode("edges").alias("ord", "e")).select("__file", F.col("ord").cast("long").alias("ord"), "e.*")
    return _graph(n, e, canonical)


def _graph(n: DataFrame, e: DataFrame, canonical: bool) -> Graph:
    """Rows of a document as a graph."""
    text = lambda df, c: F.coalesce(df[c], F.lit("")).alias(c)
    # the metadata of a row are parsed once for all fields
    parsed = lambda df, names: df.withColumn("__meta", F.from_json("metadata", ", ".join(f"`{x}` string" for x in names)))
    kept = lambda c: F.coalesce(F.col(f"__meta.{c}"), F.lit(""))
    n = parsed(n, ("layer", "canonical_key"))
    e = parsed(e, (*EDGE_METADATA.values(), "binding_suggestions"))
    nodes = n.select(
        *[text(n, c) for c in ("id", "label", "kind", "file", "description", "source_id", "source_type", "source_name", "source_path", "source_remote")], F.coalesce("source_organization", F.lit("")).alias("organization"),
        F.coalesce("community", F.lit(0)).alias("community"), kept("layer").alias("layer"), kept("canonical_key").alias("canonical_key"), "metadata", "ord",
    )
    suggestions = F.from_json("__meta.binding_suggestions", "array<string>")
    edges = e.select(
        F.coalesce("from", F.lit("")).alias("src"), F.coalesce("to", F.lit("")).alias("dst"), F.coalesce("kind", F.lit("")).alias("relation"), text(e, "confidence"), F.coalesce("score", F.lit(0.0)).alias("score"), text(e, "file"),
        *[kept(v).alias(k) for k, v in EDGE_METADATA.items()], suggestions.alias("binding_suggestions"), "metadata", "ord",
    )
    g = Graph(nodes, edges)
    return g.canonicalized() if canonical else g


def _whole(path: str) -> bool:
    """Whether a document in lines has its end."""
    with open(path.removeprefix("file://"), "rb") as f:
        f.seek(max(0, f.seek(0, 2) - 4096))
        return f.read().endswith(b"}\n")


def _broken(spark: SparkSession, path: str) -> str:
    """Why a document is none, or an empty text."""
    if in_lines(path):
        return "" if _whole(path) else "the document is cut off"
    try:
        rows = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).select(F.isnotnull("nodes").alias("n"), F.isnotnull("edges").alias("e")).take(1)
    except Exception as e:  # noqa: BLE001  one bad document does not end the union
        return str(e).splitlines()[0]
    return "" if rows and (rows[0].n or rows[0].e) else "no nodes and no edges"


def read_graphs(spark: SparkSession, paths: list[str], warnings: list[str] | None = None) -> Graph:
    """The union of several documents, earlier ones first. Missing and broken ones are left out and named in ``warnings``."""
    why = {p: _broken(spark, p) for p in paths}
    if warnings is not None:
        warnings += [f"{p}: {w}" for p, w in why.items() if w]
    good = [read_graph(spark, p, canonical=False) for p in paths if not why[p]]
    if not good:
        raise ValueError("no graph document can be read")
    return Graph.union_all(good)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size, mod_time, language, status)."""
    schema = "files array<struct<path:string,sha256:string,size:bigint,mod_time_utc:timestamp,language:string,status:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("files").alias("f")).select("f.path", "f.sha256", "f.size", F.col("f.mod_time_utc").alias("mod_time"), "f.language", "f.status")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Tracked repositories; no blank roots, the name falls back to the folder's."""
    schema = "entries array<struct<repo_root:string,name:string,remote:string,graph_path:string,manifest_path:string,report_path:string,updated_at:timestamp>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")
    root = F.regexp_replace(F.trim("repo_root"), "(?<=.)/+$", "")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.substring_index(root, "/", -1))
    return e.where(F.coalesce(F.trim("repo_root"), F.lit("")) != "").withColumns({"repo_root": root, "name": name}).orderBy("name", "repo_root")
