"""Queries of rows Q1, Q9, Q15-Q17, Q23, A6-A8, X1, X17, K5, K9 and S1: the query surface, communities, extraction and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.exports import documents, vault
from codeloom.functions.text import EXPORT_LABELS, EXPORT_RELATIONS
from codeloom.operators import binding, community, traverse
from codeloom.plans.engine import Engine
from codeloom.plans.router import QueryRequest, routed
from codeloom.sources import contracts, extract

from .projections import SUPPLY, TRADE, supply, trade
from .structure import _FILE_EXPRS, _LINK_EXPRS, _TARGET_EXPR, _files, _terms

# (form, kind, subject, target) over a nation's name
_PROMPTS = [
    ("'who uses ' || n_name", "reverse_dependencies", "n_name", "''"),
    ("'where is `' || n_name || '` used?'", "reverse_dependencies", "n_name", "''"),
    ("'what does ' || n_name || ' depend on'", "dependencies", "n_name", "''"),
    ("'what breaks if ' || n_name || ' changes?'", "impact", "n_name", "''"),
    ("'path from ' || n_name || ' to ASIA'", "path", "n_name", "'ASIA'"),
    ("'path ' || n_name || ' -> ' || lower(n_name)", "path", "n_name", "lower(n_name)"),
    ("'how does ' || n_name || ' reach EUROPE?'", "path", "n_name", "'EUROPE'"),
    ("'explain \"' || n_name || '\"'", "explain", "n_name", "''"),
    ("'Dependencies of ' || n_name || '?'", "dependencies", "n_name", "''"),
    ("'find ' || n_name", None, None, None),
]


def q23(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    asked = n.select("n_nationkey", F.posexplode(F.array(*[F.expr(p) for p, *_ in _PROMPTS])).alias("form", "question"))
    r = routed(F.col("question"))
    return asked.select("n_nationkey", "form", r["kind"].alias("kind"), r["subject"].alias("subject"), r["target"].alias("target"))


def q9(spark, sf):
    nodes, _ = _files(spark, sf)
    p = spark.read.parquet(f"{sf}/part.parquet")
    # each part with its double, the one after that, and its successor: many paths, none of them dense
    after = F.explode(F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 2 + 1, F.col("p_partkey") + 1)).alias("after")
    edges = p.select("p_partkey", after).select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("src"), F.concat(F.lit("f"), F.col("after").cast("string")).alias("dst"), F.lit("depends_on").alias("relation"))
    return traverse.ranked_file_path(nodes, edges, "f2", "f45")


def q1_impact(spark, sf):
    g = supply(spark, sf)
    return Engine(g).run(QueryRequest("impact", "catalog:part:7", limit=40))


def q15(spark, sf):
    return Engine(supply(spark, sf)).explain("NATION_12").select("src", "relation", "dst", "line")


def q16(spark, sf):
    g = supply(spark, sf)
    s = spark.read.parquet(f"{sf}/supplier.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.expr("s_nationkey = n_nationkey")).join(spark.read.parquet(f"{sf}/region.parquet"), F.expr("n_regionkey = r_regionkey"))
    refs = s.selectExpr("'memory:observation:' || CAST(s_suppkey AS STRING) AS src", f"{_TARGET_EXPR} AS dst", "'documents' AS relation", "CASE WHEN s_suppkey % 6 = 5 THEN 'repo' ELSE 'memory' END AS layer", "'reference' AS evidence_type", "'' AS reference_target")
    bound = binding.bind_references(refs, g.nodes)
    return bound.groupBy(F.coalesce("binding_state", F.lit("none")).alias("state"), (F.col("dst") == F.col("bound_target")).alias("moved")).agg(F.count("*").alias("n"))


def q17(spark, sf):
    g = supply(spark, sf)
    return Engine(g, _terms(spark, sf)).route("Which NATION_1 repos do machinery?", 10).select("repo", "score")


def a6(spark, sf):
    g = supply(spark, sf).parallel()
    return community.numbered(community.label_propagation(g.nodes, g.edges, 6))


def a6_components(spark, sf):
    """A6 on a sparser graph: who contains, places and includes what."""
    e = trade(spark, sf)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return community.numbered(community.label_propagation(nodes, e, 6))


def _sources(spark, sf):
    """A small repository: a Python, a Go and a TypeScript file for each part size."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_size").cast("string").alias("n")).distinct()
    py = p.select(F.concat(F.lit("svc/m"), "n", F.lit(".py")).alias("path"), F.concat(F.lit("import svc.m1\nclass C"), "n", F.lit(":\n    def run"), "n", F.lit("(self):\n        self.help()\n\ndef make():\n    return C"), "n", F.lit("()\n")).alias("content"))
    go = p.select(F.concat(F.lit("cmd/m"), "n", F.lit(".go")).alias("path"), F.concat(F.lit("package cmd\n\ntype T"), "n", F.lit(" struct {\n}\n\nfunc Start"), "n", F.lit("() {\n\tStop()\n}\n")).alias("content"))
    ts = p.select(F.concat(F.lit("web/m"), "n", F.lit(".ts")).alias("path"), F.concat(F.lit("import { a } from './m1';\nexport function f"), "n", F.lit("() {\n  a();\n}\nconst g = () => {\n  a();\n};\n")).alias("content"))
    return py.unionByName(go).unionByName(ts)


def x1(spark, sf):
    g = extract.extracted(_sources(spark, sf), "shop", "shop")
    n = g.nodes.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n"))
    return n.unionByName(g.edges.groupBy(F.concat(F.lit("edge "), "relation").alias("what")).agg(F.count("*").alias("n")))


def x17(spark, sf):
    p = spark.read.parquet(f"{sf}/nation.parquet")
    files = p.select(F.concat(F.lit("api/"), "n_name", F.lit(".proto")).alias("path"), F.concat(F.lit("service S"), F.col("n_nationkey").cast("string"), F.lit(" {\n  rpc Get(R) returns (S);\n  rpc Put(R) returns (S);\n}\n")).alias("content"))
    g = contracts.contracts(files, "project:ASIA")
    return g.edges.select("src", "relation", "dst", "confidence")


def k5(spark, sf):
    g = supply(spark, sf)
    return vault.note_paths(g.nodes)


def k9(spark, sf):
    return documents.cypher(supply(spark, sf)).select("statement")


QUERIES = {
    "Q23_router": q23, "Q9_ranked_path": q9, "Q1_impact_request": q1_impact, "Q15_explain_lines": q15, "Q16_bound_references": q16, "Q17_route": q17, "A6_label_propagation": a6, "A6_sparse_communities": a6_components,
    "X1_extraction": x1, "X17_contracts": x17, "K5_note_paths": k5, "K9_cypher": k9,
}

_ASKED = " UNION ALL ".join(f"SELECT n_nationkey, {k}::INT AS form, {'NULL' if kind is None else repr(kind)}::VARCHAR AS kind, {s or 'NULL'}::VARCHAR AS subject, {t or 'NULL'}::VARCHAR AS target FROM nation" for k, (_, kind, s, t) in enumerate(_PROMPTS))

SQL = {
    "Q23_router": _ASKED,
    "Q1_impact_request": f"""WITH {SUPPLY}, e AS (SELECT DISTINCT src, coalesce(i.id, l.id) AS dst FROM edges LEFT JOIN nodes i ON dst = i.id LEFT JOIN (SELECT label, arg_min(id, ord) AS id FROM nodes GROUP BY label) l ON dst = l.label),
        h1 AS (SELECT DISTINCT src AS id FROM e WHERE dst = 'catalog:part:7'), h2 AS (SELECT DISTINCT src AS id FROM e WHERE dst IN (SELECT id FROM h1)), h3 AS (SELECT DISTINCT src AS id FROM e WHERE dst IN (SELECT id FROM h2)),
        a AS (SELECT id, min(h)::INT AS hops FROM (SELECT id, 1 AS h FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3) GROUP BY id) SELECT id, hops FROM a JOIN nodes USING (id) ORDER BY ord, id LIMIT 40""",
    "Q15_explain_lines": f"""WITH {SUPPLY}, n AS (SELECT *, coalesce(nullif(label, ''), id) || ' [repo/' || kind || ']' AS name FROM nodes), ids AS (SELECT id FROM nodes WHERE label = 'NATION_12')
        SELECT DISTINCT src, relation, dst, a.name || ' --[' || relation || ']--> ' || b.name || CASE WHEN coalesce(confidence, '') <> '' THEN ' {{confidence=' || lower(confidence) || '}}' ELSE '' END AS line FROM edges JOIN n a ON src = a.id JOIN n b ON dst = b.id WHERE src IN (SELECT id FROM ids) OR dst IN (SELECT id FROM ids)""",
    "X17_contracts": """WITH s AS (SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation) SELECT 'contract:service:s' || k AS src, 'declares' AS relation, 'contract:rpc:s' || k || ':' || m AS dst, 'DECLARED' AS confidence FROM s, (VALUES ('get'), ('put')) t(m)
        UNION ALL SELECT 'contract:service:s' || k, 'declared_in', 'project:ASIA', 'DECLARED' FROM s""",
    "X1_extraction": """WITH p AS (SELECT DISTINCT p_size AS n FROM part), c AS (SELECT count(*) AS k, count(*) FILTER (n = 1) AS one FROM p)
        SELECT 'project' AS what, 1 AS n UNION ALL SELECT 'file', 3 * k FROM c UNION ALL SELECT 'function', 5 * k FROM c UNION ALL SELECT 'struct', 2 * k FROM c UNION ALL SELECT 'edge contains', 3 * k + 7 * k FROM c
        UNION ALL SELECT 'edge calls', 4 * k FROM c UNION ALL SELECT 'edge depends_on', 2 * (k - 1) FROM c WHERE one = 1""",
}


def _quoted(column: str) -> str:
    return rf"'''' || replace(replace(coalesce({column}, ''), '\', '\\'), '''', '\''') || ''''"


def _named(column: str, table: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


SQL["K9_cypher"] = f"WITH {SUPPLY} SELECT 'MERGE (n:' || {_named('kind', EXPORT_LABELS, 'Node')} || ' {{id: ' || {_quoted('id')} || '}}) SET n.label = ' || {_quoted('label')} || ', n.file = ' || {_quoted('file')} || ';' AS statement FROM nodes UNION ALL SELECT 'MATCH (a {{id: ' || {_quoted('src')} || '}}), (b {{id: ' || {_quoted('dst')} || '}}) MERGE (a)-[:' || {_named('relation', EXPORT_RELATIONS, 'RELATED_TO')} || ']->(b);' FROM edges"
