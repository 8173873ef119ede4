"""Graph.parallel against Graph.built: the same edges, parallel ones as often, without choosing a first copy."""

from codeloom.operators import graph as G
from codeloom.queries import surface


def test_parallel_is_built_without_winners(spark):
    edges = [("a", "b", "calls", f, c, float(k), k) for k, (f, c) in enumerate([("x.go", "A"), ("x.go", "B"), ("y.go", None), (None, "C"), ("", "D")])]
    edges += [("a", "B", "calls", "x.go", None, 0.0, 9), ("a", "a", "calls", "", None, 0.0, 10), ("ghost", "a", "calls", "", None, 0.0, 11), ("b", "missing", "calls", "", None, 0.0, 12), ("", "a", "uses", "", None, 0.0, 13), ("b", "a", "uses", "", None, 0.0, 14)]
    nodes = [("a", "A", "f", "", 0), ("b", "B", "f", "", 1), ("b", "again", "f", "", 2), ("c", "B", "f", "", 3), ("", "none", "f", "", 4)]
    g = G.Graph(spark.createDataFrame(nodes, "id string, label string, kind string, file string, ord long"), spark.createDataFrame(edges, "src string, dst string, relation string, file string, confidence string, score double, ord long"))
    rows = lambda x: sorted(map(tuple, x.edges.select("src", "dst", "relation", "file", "dst_raw").collect()))
    assert rows(g.parallel()) == rows(g.built()) and len(rows(g.parallel())) == 5
    assert sorted(map(tuple, g.parallel().nodes.collect())) == sorted(map(tuple, g.built().nodes.collect()))


def test_label_propagation_sorts_no_edges_for_winners(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(surface.community, "label_propagation", lambda nodes, edges, rounds: seen.append(edges) or nodes.select("id", nodes.id.alias("label")))
    surface.a6(spark, "/root/testdata/sf0.001")
    assert "min(struct" not in seen[0].select("src", "dst")._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0] and "score" not in seen[0].columns
