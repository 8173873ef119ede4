"""Queries of rows R1-R3, A1-A17, Q19, Q20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import analytics as A
from codeloom.operators import graph as G

from .projections import CANON, RAW_SUPPLY, RESOLVED, SIMPLE, SUPPLY, TRADE, supply, trade


def r1(spark: SparkSession, sf: str) -> DataFrame:
    return G.canonical_nodes(supply(spark, sf, True).nodes).select("id", "label", "kind", "file", "ord")


def r2(spark, sf):
    g = supply(spark, sf, True).canonicalized()
    return g.edges.select("src", "dst", "relation", "file", "confidence", "score", "ord")


def r3(spark, sf):
    return supply(spark, sf, True).built().edges.select("src", "dst", "relation", "dst_raw", "dst_label", "ord")


def r19(spark, sf):
    g = supply(spark, sf)
    other = G.Graph(g.nodes.where("community = 1").withColumn("label", F.upper("label")), g.edges.where("relation = 'contains'").withColumn("confidence", F.lit("DECLARED")))
    u = g.union(other)
    return u.nodes.groupBy("kind").agg(F.count("*").alias("nodes"), F.min("label").alias("least_label")).orderBy("kind")


def a1a_kind(spark, sf):
    return A.histogram(supply(spark, sf).nodes, "kind")


def a1a_relation(spark, sf):
    return A.histogram(supply(spark, sf).edges, "relation")


def a1a_confidence(spark, sf):
    return A.histogram(supply(spark, sf).edges, "confidence", "UNSET")


def a1b(spark, sf):
    g = supply(spark, sf, True)
    return A.edge_quality(g.nodes, g.edges).withColumn("resolution_rate", F.round("resolution_rate", 6))


def a1d(spark, sf):
    g = supply(spark, sf)
    return A.degrees(g.nodes, g.edges)


def a1e(spark, sf):
    return A.degree_stats(a1d(spark, sf)).withColumn("avg_degree", F.round("avg_degree", 6))


def a1f(spark, sf):
    return A.community_stats(supply(spark, sf).nodes)


def a1g(spark, sf):
    g = supply(spark, sf)
    return A.modularity(g.nodes, g.edges)


def a1h(spark, sf):
    g = supply(spark, sf)
    return A.top_by_out_degree(g.nodes, g.edges, 20)


def a2(spark, sf):
    g = supply(spark, sf).linked()
    return A.god_nodes(g.nodes, g.edges, 10)


def a3(spark, sf):
    return A.simple_degrees(supply(spark, sf).linked().edges)


def a4(spark, sf):
    g = supply(spark, sf).linked()
    return A.surprise_edges(g.nodes, g.edges, 20)


def a5(spark, sf):
    gods = [r.label for r in a2(spark, sf).limit(3).collect()]
    return spark.createDataFrame(list(enumerate(A.suggested_questions(gods))), "position int, question string")


def a11(spark, sf):
    g = supply(spark, sf)
    return A.project_status(g.nodes, g.edges)


def a12(spark, sf):
    return A.registry_rollup(a11(spark, sf))


def a14(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    yearly = o.groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))
    return A.snapshot_deltas(yearly, "o_orderpriority", "year", ["orders", "customers"])


def a15(spark, sf):
    g = supply(spark, sf)
    return A.drawn_nodes(g.nodes, A.degrees(g.nodes, g.edges))


def a16(spark, sf):
    n = supply(spark, sf).nodes
    return n.groupBy("organization", "source_name", "kind").agg(F.count("*").alias("n"))


def a17(spark, sf):
    g = supply(spark, sf)
    picked = g.nodes.withColumn("organization", F.when(F.col("community") < 2, "near").otherwise("far"))
    n, e = A.organization_subgraph(picked, g.edges, "near")
    return e.groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


def q19(spark, sf):
    g = supply(spark, sf)
    return A.neighbours(g.edges, g.nodes, "catalog:part:7")


def q20(spark, sf):
    g = supply(spark, sf)
    kinds = A.histogram(g.nodes, "kind").select(F.lit("kind").alias("what"), "key", "n")
    confidence = A.histogram(g.edges, "confidence", "unknown").select(F.lit("confidence").alias("what"), "key", "n")
    sizes = g.nodes.agg(F.count("*").alias("nodes"), F.countDistinct(F.when(F.col("community") != 0, F.col("community"))).alias("communities")).crossJoin(g.edges.agg(F.count("*").alias("edges")))
    sizes = sizes.select(F.explode(F.array(*[F.struct(F.lit("size").alias("what"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in ("nodes", "edges", "communities")])).alias("x")).select("x.*")
    return kinds.unionByName(confidence).unionByName(sizes)


def reach_counts(spark, sf):
    e = trade(spark, sf)
    return e.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))


QUERIES = {
    "R1_canonical_nodes": r1, "R2_canonical_edges": r2, "R3_build": r3, "R19_union": r19,
    "A1a_nodes_by_kind": a1a_kind, "A1a_edges_by_relation": a1a_relation, "A1a_confidence": a1a_confidence, "A1b_A1c_edge_quality": a1b,
    "A1d_degrees": a1d, "A1e_degree_stats": a1e, "A1f_communities": a1f, "A1g_modularity": a1g, "A1h_top_out_degree": a1h,
    "A2_god_nodes": a2, "A3_simple_degree": a3, "A4_surprise_edges": a4, "A5_questions": a5, "A11_project_status": a11, "A12_registry_rollup": a12,
    "A14_snapshot_deltas": a14, "A15_drawn_nodes": a15, "A16_memberships": a16, "A17_organization_subgraph": a17, "Q19_neighbours": q19, "Q20_stats": q20,
    "G2_trade_relations": reach_counts,
}

_DEG = f"""{RESOLVED}, ends AS (SELECT src AS id, 1 AS o FROM re WHERE src IS NOT NULL AND dst IS NOT NULL UNION ALL SELECT dst, 0 FROM re WHERE src IS NOT NULL AND dst IS NOT NULL),
deg AS (SELECT n.id, coalesce(sum(o), 0)::BIGINT AS out_degree, (count(e.id) - coalesce(sum(o), 0))::BIGINT AS in_degree, count(e.id)::BIGINT AS degree FROM nodes n LEFT JOIN ends e ON n.id = e.id GROUP BY n.id)"""

_GODS = f"{CANON}, {SIMPLE}, gods AS (SELECT cn.id, label, kind, coalesce(degree, 0) AS degree FROM cn LEFT JOIN sd ON cn.id = sd.id ORDER BY degree DESC, cn.id LIMIT 10)"
_STATUS = """
proj AS (SELECT regexp_extract(id, '^project:(.*)$', 1) AS project, label FROM nodes WHERE kind = 'project'),
own AS (SELECT id, kind, CASE WHEN kind = 'project' THEN regexp_extract(id, '^project:(.*)$', 1) WHEN coalesce(source_id, '') <> '' THEN source_id ELSE split_part(id, ':', 1) END AS project FROM nodes),
status AS (
    SELECT project, label, coalesce(n, 0)::BIGINT AS nodes, coalesce(f, 0)::BIGINT AS files, coalesce(s, 0)::BIGINT AS symbols, coalesce(o, 0)::BIGINT AS outgoing FROM proj
    LEFT JOIN (SELECT project, count(*) AS n, count(*) FILTER (kind = 'file') AS f, count(*) FILTER (kind NOT IN ('file', 'project')) AS s FROM own GROUP BY project) USING (project)
    LEFT JOIN (SELECT project, count(*) AS o FROM edges JOIN own ON src = id GROUP BY project) USING (project))
"""

SQL = {
    "R1_canonical_nodes": f"WITH {RAW_SUPPLY}, {CANON} SELECT id, label, kind, file, ord FROM cn",
    "R2_canonical_edges": f"WITH {RAW_SUPPLY}, {CANON} SELECT src, dst, relation, coalesce(file, '') AS file, confidence, score, ord FROM ce",
    "R3_build": f"WITH {RAW_SUPPLY}, {CANON} SELECT b.src, b.dst, b.relation, b.dst_raw, cn.label AS dst_label, b.ord FROM built b JOIN cn ON b.dst = cn.id",
    "R19_union": f"""WITH {SUPPLY}, u AS (SELECT id, label, kind, 0 AS g, ord FROM nodes UNION ALL SELECT id, upper(label), kind, 1, ord FROM nodes WHERE community = 1),
        f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY g, ord) = 1) SELECT kind, count(*) AS nodes, min(label) AS least_label FROM f GROUP BY kind""",
    "A1a_nodes_by_kind": f"WITH {SUPPLY} SELECT kind AS key, count(*) AS n FROM nodes GROUP BY kind",
    "A1a_edges_by_relation": f"WITH {SUPPLY} SELECT relation AS key, count(*) AS n FROM edges GROUP BY relation",
    "A1a_confidence": f"WITH {SUPPLY} SELECT CASE WHEN coalesce(confidence, '') = '' THEN 'UNSET' ELSE confidence END AS key, count(*) AS n FROM edges GROUP BY 1",
    "A1b_A1c_edge_quality": f"""WITH {RAW_SUPPLY}, {RESOLVED} SELECT count(*) AS edges, count(*) FILTER (src IS NULL OR dst IS NULL) AS broken, count(*) FILTER (src = dst) AS self_loops,
        (count(*) FILTER (src IS NOT NULL AND dst IS NOT NULL) - (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM re WHERE src IS NOT NULL AND dst IS NOT NULL)))::BIGINT AS duplicates,
        round((count(*) - count(*) FILTER (src IS NULL OR dst IS NULL)) / count(*), 6) AS resolution_rate FROM re""",
    "A1d_degrees": f"WITH {SUPPLY}, {_DEG} SELECT * FROM deg",
    "A1e_degree_stats": f"""WITH {SUPPLY}, {_DEG}, r AS (SELECT degree, row_number() OVER (ORDER BY degree) AS k, count(*) OVER () AS n FROM deg)
        SELECT round(avg(degree), 6) AS avg_degree, min(degree) FILTER (k = n // 2 + 1) AS median_degree, min(degree) FILTER (k = CAST(ceil(n * 0.95) AS BIGINT)) AS p95_degree, max(degree) AS max_degree,
        count(*) FILTER (degree = 0) AS isolated, count(*) FILTER (degree = 1) AS leaves, count(*) FILTER (degree >= 10) AS hubs, (100 * count(*) FILTER (degree > 0)) // count(*) AS connected_pct FROM r""",
    "A1f_communities": f"WITH {SUPPLY}, c AS (SELECT community, count(*) AS n FROM nodes GROUP BY 1) SELECT count(*) AS communities, max(n) AS largest, count(*) FILTER (n = 1) AS singletons FROM c",
    "A1g_modularity": f"""WITH {SUPPLY}, {RESOLVED}, x AS (SELECT a.community AS cs, b.community AS cd FROM re JOIN nodes a ON re.src = a.id JOIN nodes b ON re.dst = b.id),
        p AS (SELECT c, sum(i) AS i, sum(1) AS d FROM (SELECT cs AS c, CASE WHEN cs = cd THEN 1 ELSE 0 END AS i FROM x UNION ALL SELECT cd, 0 FROM x) GROUP BY c), m AS (SELECT count(*)::DOUBLE AS m FROM x)
        SELECT round(sum(i / m - (d / (2 * m)) * (d / (2 * m))), 6) AS modularity FROM p, m""",
    "A1h_top_out_degree": f"WITH {SUPPLY}, {_DEG} SELECT id, label, kind, out_degree, in_degree FROM deg JOIN nodes USING (id) ORDER BY out_degree DESC, id LIMIT 20",
    "A2_god_nodes": f"WITH {SUPPLY}, {_GODS} SELECT * FROM gods",
    "A3_simple_degree": f"WITH {SUPPLY}, {CANON}, {SIMPLE} SELECT id, degree FROM sd",
    "A4_surprise_edges": f"""WITH {SUPPLY}, {CANON}, {SIMPLE}, c AS (SELECT cn.id, community AS c, coalesce(degree, 0) AS degree FROM cn LEFT JOIN sd ON cn.id = sd.id)
        SELECT e.src, e.dst, e.relation, a.c AS src_community, b.c AS dst_community, a.degree * b.degree AS score FROM (SELECT DISTINCT src, dst, relation FROM built) e JOIN c a ON e.src = a.id JOIN c b ON e.dst = b.id
        WHERE a.c <> b.c ORDER BY score DESC, e.src, e.dst, e.relation LIMIT 20""",
    "A5_questions": f"""WITH {SUPPLY}, {_GODS}, g AS (SELECT list(label ORDER BY degree DESC, id) AS l FROM gods)
        SELECT (p - 1)::INT AS position, q AS question FROM (SELECT unnest(['What does ' || l[1] || ' depend on, and what depends on it?', 'What is the shortest dependency path from ' || l[1] || ' to ' || l[2] || '?', 'Which components would break if ' || l[1] || ' changed its interface?',
        'Which communities are most isolated from the rest of the graph?', 'What are the most unexpected cross-domain connections in this codebase?']) AS q, unnest(range(1, 6)) AS p FROM g)""",
    "A11_project_status": f"WITH {SUPPLY}, {_STATUS} SELECT * FROM status",
    "A12_registry_rollup": f"""WITH {SUPPLY}, {_STATUS} SELECT count(*) AS projects, count(*) FILTER (nodes > 0) AS healthy, count(*) FILTER (nodes = 0) AS missing, sum(nodes)::BIGINT AS nodes, sum(files)::BIGINT AS files,
        sum(symbols)::BIGINT AS symbols, sum(outgoing)::BIGINT AS outgoing FROM status""",
    "A14_snapshot_deltas": """WITH y AS (SELECT o_orderpriority, year(o_orderdate)::INT AS year, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2)
        SELECT *, orders - lag(orders) OVER w AS orders_delta, customers - lag(customers) OVER w AS customers_delta FROM y WINDOW w AS (PARTITION BY o_orderpriority ORDER BY year)""",
    "A15_drawn_nodes": f"""WITH {SUPPLY}, {_DEG} SELECT n.id, n.label, degree, (10 + floor(30 * degree / (SELECT max(degree) FROM deg)))::BIGINT AS size,
        list_extract(['#4e79a7', '#f28e2b', '#e15759', '#76b7b2', '#59a14f', '#edc948', '#b07aa1', '#ff9da7', '#9c755f', '#bab0ac', '#86bcb6', '#d37295'], community % 12 + 1) AS colour FROM nodes n JOIN deg USING (id)""",
    "A16_memberships": f"WITH {SUPPLY} SELECT organization, source_name, kind, count(*) AS n FROM nodes GROUP BY ALL",
    "A17_organization_subgraph": f"""WITH {SUPPLY}, n AS (SELECT * FROM nodes WHERE community < 2), k AS (SELECT id AS k FROM n UNION SELECT label FROM n WHERE label <> '')
        SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT k FROM k) GROUP BY relation""",
    "Q19_neighbours": f"""WITH {SUPPLY}, {RESOLVED} SELECT 'out' AS direction, n.id, label, relation FROM re JOIN nodes n ON re.dst = n.id WHERE src = 'catalog:part:7'
        UNION ALL SELECT 'in', n.id, label, relation FROM re JOIN nodes n ON re.src = n.id WHERE dst = 'catalog:part:7' AND src <> 'catalog:part:7'""",
    "Q20_stats": f"""WITH {SUPPLY} SELECT 'kind' AS what, kind AS key, count(*) AS n FROM nodes GROUP BY kind
        UNION ALL SELECT 'confidence', CASE WHEN coalesce(confidence, '') = '' THEN 'unknown' ELSE confidence END, count(*) FROM edges GROUP BY 2
        UNION ALL SELECT 'size', 'nodes', count(*) FROM nodes UNION ALL SELECT 'size', 'edges', count(*) FROM edges UNION ALL SELECT 'size', 'communities', count(DISTINCT community) FROM nodes WHERE community <> 0""",
    "G2_trade_relations": f"WITH {TRADE} SELECT relation, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY relation",
}
