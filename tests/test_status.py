from pyspark.sql import functions as F

from codeloom.operators import status
from codeloom.operators.graph import Graph


def test_status(spark):
    nodes = spark.createDataFrame([("a", "A", 0, 1), ("b", "B", 0, 2), ("c", "C", 3, 3)], "id string, label string, community int, ord long")
    edges = spark.createDataFrame([("a", "b", "x", "EXTRACTED", 1), ("a", "b", "y", "", 2), ("a", "gone", "x", "", 3), ("c", "c", "x", "", 4)], "src string, dst string, relation string, confidence string, ord long")
    h = status.health(Graph(nodes, edges)).first()
    assert (h.nodes, h.edges, h.broken, h.self_loops, h.duplicates, h.resolution_rate, h.extracted_rate) == (3, 4, 1, 1, 1, 0.75, 0.25)
    assert (h.median_degree, h.p95_degree, h.max_degree, h.isolated, h.connected_pct, h.communities, h.largest, h.singletons) == (2, 2, 2, 0, 100, 2, 2, 1)
    assert {tuple(r) for r in status.members(nodes).collect()} == {(0, 2), (3, 1)}
    assert status.members(nodes.withColumn("community", F.lit(0))).count() == 0
    none = status.health(Graph(nodes, edges.where("false"))).first()
    assert (none.edges, none.resolution_rate, none.modularity, none.extracted_rate) == (0, 0.0, 0.0, 0.0)


def test_gates(spark):
    m = spark.createDataFrame([("cover", 0.98), ("build", 1500.0)], "metric string, value double")
    limits = spark.createDataFrame([("cover", 0.99, None), ("build", None, 2000.0), ("gone", 1.0, None)], "metric string, least double, most double")
    got = {r.metric: (r.passed, None if r.deficit is None else round(r.deficit, 6)) for r in status.gates(m, limits).collect()}
    assert got == {"cover": (False, 0.01), "build": (True, 0.0), "gone": (False, None)}
    f = spark.sql("select 'a' path, 3L size, timestamp'2024-01-02' mod_time")
    assert status.freshness(f, f).first().fresh and not status.freshness(f, f.withColumn("size", F.lit(0))).first().fresh
    r = spark.range(1).select(status.progress(F.lit(5), F.lit(10), F.lit(20.0)), status.inside(F.lit("/a/b"), "/a"), status.inside(F.lit("/ab"), "/a"), status.inside(F.lit("/a/../b"), "/a")).first()
    assert tuple(r[0]) == (50.0, 40.0, 20.0) and (r[1], r[2], r[3]) == (True, False, False)
    n = spark.sql("select 7 number, 't' title, null content, 'w' workspace, 'v' visibility, 'o' organization, timestamp'2024-03-05 10:00:00' created_at")
    o = status.observation_nodes(n).first()
    assert (o.id, o.description, o.created_at) == ("memory:observation:7", "", "2024-03-05")
