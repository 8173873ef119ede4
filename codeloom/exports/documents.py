"""Graph documents, reports, pages and statements (rows K1-K4, K8-K10, F10). Rows are made by Spark and written by tasks; a page and a report are of bounded size."""

from __future__ import annotations

import html
import json
import textwrap
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import export_label, export_relation
from codeloom.operators import analytics
from codeloom.operators.graph import Graph

from .staged import write_document

_NODE_FIELDS = {"id": "id", "label": "label", "kind": "kind", "file": "file", "description": "description", "source_id": "source_id", "source_type": "source_type", "source_name": "source_name", "organization": "source_organization", "source_path": "source_path", "source_remote": "source_remote", "community": "community"}
_EDGE_FIELDS = {"src": "from", "dst": "to", "relation": "kind", "file": "file", "confidence": "confidence", "score": "score"}
_ALWAYS = ("id", "label", "kind", "from", "to")
_NODE_META = ("layer", "canonical_key", "evidence_type", "evidence_confidence")
_EDGE_META = ("layer", "evidence_type", "evidence_confidence", "verification", "projected_from", "reference_target", "bound_target", "binding_state", "binding_evidence", "binding_suggestions")


def _json_rows(df: DataFrame, fields: dict[str, str], meta: tuple[str, ...]) -> DataFrame:
    """(ord, json): one JSON text a row; empty, zero and null fields are left out."""

    def value(c: str, name: str):
        v = F.col(c)
        if name in _ALWAYS:
            return F.coalesce(v, F.lit("")).alias(name)
        kind = dict(df.dtypes)[c]
        empty = v == "" if kind == "string" else F.size(v) == 0 if kind.startswith("array") else v == 0
        return F.when(~empty, v).alias(name)

    top = [value(c, n) for c, n in fields.items() if c in df.columns]
    inner = [value(c, c) for c in meta if c in df.columns]
    if inner:
        # a field that is left out is null
        some = F.coalesce(*[F.when(v.isNotNull(), F.lit(True)) for v in inner], F.lit(False))
        top.append(F.when(some, F.struct(*inner)).alias("metadata"))
    return df.select("ord", F.to_json(F.struct(*top)).alias("json"))


def write_tables(g: Graph, path: str) -> None:
    """K1: the graph as two Parquet tables, the form for graphs of size."""
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_json(g: Graph, path: str) -> None:
    """K1: the canonical graph as one JSON document, a row a line, put together by tasks."""
    g = g.canonicalized()
    sections = {"nodes": _json_rows(g.nodes, _NODE_FIELDS, _NODE_META), "edges": _json_rows(g.edges, _EDGE_FIELDS, _EDGE_META)}
    write_document(sections, path, tail=lambda n: {"meta": {"nodeCount": n["nodes"], "edgeCount": n["edges"], "generatedAt": _now()}})


def write_manifest(manifest: DataFrame, path: str, repo_root: str = "", build_mode: str = "full_rebuild", fingerprint: str = "") -> None:
    """K2: a manifest as one JSON document, files in order of their paths."""
    head = {"version": 1, "repo_root": repo_root, "generated_at": _now(), "build_mode": build_mode, "fingerprint": fingerprint}
    write_document({"files": manifest.select(F.col("path").alias("ord"), F.to_json(F.struct("*")).alias("json"))}, path, head)


def report(g: Graph, most: int | None = 1000) -> str:
    """K4: a Markdown report of a built graph: sizes, god nodes, communities, surprises, questions.

    Lists the first ``most`` communities (None: all) with their first labels, as many as a line can show; the number is that of all.
    """
    gods = analytics.god_nodes(g.nodes, g.edges, 5).join(g.nodes.select("id", "file"), "id").orderBy(F.desc("degree"), "id").collect()
    surprises = analytics.surprise_edges(g.nodes, g.edges, 5).collect()
    in_ = g.nodes.select(F.coalesce("community", F.lit(0)).alias("c"), F.left("label", F.lit(80)).alias("label"))
    first = in_.distinct().where("label is not null").withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("label"))).where("k <= 40")
    labels = first.groupBy("c").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("labels"))
    sizes = in_.groupBy("c").agg(F.count("*").alias("n"))
    n_communities = sizes.count()
    listed = sizes.orderBy("c") if most is None else sizes.orderBy("c").limit(most)
    members = listed.join(labels, "c", "left").select("c", "n", F.coalesce("labels", F.lit("")).alias("labels")).orderBy("c").collect()
    if [r.c for r in members] == [0]:
        members, n_communities = [], 0
    n_nodes, n_edges = g.nodes.count(), g.edges.count()
    out = [f"# The graph: {n_nodes} nodes, {n_edges} edges, {n_communities} communities"]

    def section(title: str, rows: list[str], without: str) -> None:
        out.extend(["", f"## {title}", "", *(rows or [f"*{without}*"])])

    section("Most connected", [f"* `{r.label}` ({r.kind}), {r.degree} neighbours" + (f", in {r.file}" if r.file else "") for r in gods], "The graph has no nodes.")
    section("Communities", [f"* {r.c}: {r.n} nodes - {textwrap.shorten(r.labels, 90, placeholder=' …')}" for r in members], "The graph was not clustered.")
    section("Links between communities", [f"* `{r.src}` {r.relation} `{r.dst}`" for r in surprises], "No link leaves its community.")
    section("What to ask", [f"* {q}" for q in analytics.suggested_questions([r.label for r in gods])], "Nothing to ask.")
    return "\n".join(out) + "\n"


def page(g: Graph, title: str = "Graph", most: int | None = 5000, most_edges: int | None = 50_000) -> str:
    """K3: one HTML page that draws the ``most`` nodes of highest degree and the first ``most_edges`` edges among them, None: all (a page is for looking at)."""
    degree = analytics.degrees(g.nodes, g.edges)
    drawn = analytics.drawn_nodes(g.nodes, degree).orderBy(F.desc("degree"), "id")
    drawn = drawn if most is None else drawn.limit(most)
    nodes = [r.asDict() for r in drawn.collect()]
    ids = drawn.select("id")
    e = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "relation").distinct().orderBy("src", "dst", "relation")
    e = e if most_edges is None else e.limit(most_edges)
    data = json.dumps({"nodes": nodes, "edges": [[r.src, r.dst, r.relation] for r in e.collect()]}).replace("</", "<\\/")
    return _PAGE.replace("@TITLE@", html.escape(title)).replace("@DATA@", data)


_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>@TITLE@</title><style>body{margin:0;font:14px sans-serif}svg{width:100vw;height:100vh}line{stroke:#bbb}</style></head><body><svg id="s"></svg><script>
const g=@DATA@,s=document.getElementById("s"),N="http://www.w3.org/2000/svg",at={};
const make=(k,o)=>{const x=document.createElementNS(N,k);for(const a in o)x.setAttribute(a,o[a]);s.appendChild(x);return x};
g.nodes.forEach((n,i)=>{const t=i*2.39996,r=14*Math.sqrt(i);at[n.id]=[innerWidth/2+r*Math.cos(t),innerHeight/2+r*Math.sin(t)]});
g.edges.forEach(([a,b,k])=>{make("line",{x1:at[a][0],y1:at[a][1],x2:at[b][0],y2:at[b][1]})});
g.nodes.forEach(n=>{const c=make("circle",{cx:at[n.id][0],cy:at[n.id][1],r:n.size/4,fill:n.colour});const t=document.createElementNS(N,"title");t.textContent=n.label+" ("+n.degree+")";c.appendChild(t)});
</script></body></html>
"""


def cypher(g: Graph) -> DataFrame:
    """MERGE statements (statement) for a property-graph database, nodes and then edges by ord."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    n = g.nodes.select(F.lit(0).alias("part"), "ord", F.concat(F.lit("MERGE (n:"), export_label(F.col("kind")), F.lit(" {id: "), quoted("id"), F.lit("}) SET n.label = "), quoted("label"), F.lit(", n.file = "), quoted("file"), F.lit(";")).alias("statement"))
    e = g.edges.select(F.lit(1).alias("part"), "ord", F.concat(F.lit("MATCH (a {id: "), quoted("src"), F.lit("}), (b {id: "), quoted("dst"), F.lit("}) MERGE (a)-[:"), export_relation(F.col("relation")), F.lit("]->(b);")).alias("statement"))
    return n.unionByName(e)


def push(g: Graph, connect: Callable[[], Callable[[str], object]], rejects: str) -> int:
    """K9: runs the statements of ``g`` in tasks, all nodes before the first edge; the number of those that failed.

    ``connect`` is called once a task and gives what runs one statement. A statement that raises is written to the Parquet
    table ``rejects`` (part, ord, statement, error), which is replaced, and the rest go on. A task that is lost runs its
    statements again: they merge, so that changes nothing. Without statements the table is empty.
    """
    spark = g.nodes.sparkSession
    schema = "part int, ord long, statement string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = None
        for b in batches:
            failed = []
            for row in b.to_pylist():
                send = send or connect()
                try:
                    send(row["statement"])
                except Exception as e:  # noqa: BLE001  what the database says is a row of the result
                    failed.append(row | {"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(failed, pa.schema([("part", pa.int32()), ("ord", pa.int64()), ("statement", pa.string()), ("error", pa.string())]))

    every = cypher(g).select("part", F.col("ord").cast("long").alias("ord"), "statement")
    for part, mode in ((0, "overwrite"), (1, "append")):
        every.where(F.col("part") == part).mapInArrow(run, schema).write.mode(mode).parquet(rejects)
    return spark.read.schema(schema).parquet(rejects).count()
