"""Tables beyond a part are dealt into more parts by their size, with the same results."""

import random

import pytest

from codeloom import session
from codeloom.operators import analytics, graph, traverse


@pytest.fixture
def small_parts(monkeypatch):
    """Parts of some 16 rows."""
    monkeypatch.setattr(session.dealt, "__kwdefaults__", {"most": 16})


def supply(spark):
    rng = random.Random(11)
    nodes = [(f"n{k}", f"L{k % 30}", "file" if k < 12 else "function", f"L{k % 12}", k) for k in range(60)]
    edges = [(rng.choice(["n", "L", "gone"]) + str(rng.randrange(60)), rng.choice(["n", "L", "gone"]) + str(rng.randrange(60)), rng.choice(["calls", "uses", "contains"]), "static_import" if k % 3 else "", k) for k in range(400)]
    return nodes, edges, graph.Graph(spark.createDataFrame(nodes, "id string, label string, kind string, file string, ord long"), spark.createDataFrame(edges, "src string, dst string, relation string, projected_from string, ord long"))


def parts(df) -> int:
    return df.rdd.getNumPartitions()


def test_file_projection_parts(spark, small_parts):
    nodes, edges, g = supply(spark)
    got = graph.file_projection(g)
    ids, label = {n[0] for n in nodes}, {}
    for n in nodes:
        label.setdefault(n[1], n[0])
    file = {n[0]: n[0] if n[2] == "file" else next((m[0] for m in nodes if m[2] == "file" and m[1] == n[3]), None) for n in nodes}
    want = {}
    for src, dst, relation, _, o in edges:
        dst = dst if dst in ids else label.get(dst)
        a, b = file.get(src), file.get(dst)
        if relation != "contains" and a and b and a != b:
            want[a, b] = min(want.get((a, b), (o, relation)), (o, relation))
    assert {(r.src, r.dst): (r.ord, r.projected_from) for r in got.collect()} == want
    assert parts(got) == -(-sum(e[2] != "contains" for e in edges) // 16)


def test_edge_quality_parts(spark, small_parts):
    nodes, edges, g = supply(spark)
    ids, label = {n[0] for n in nodes}, {}
    for n in nodes:
        label.setdefault(n[1], n[0])
    ends = [tuple(x if x in ids else label.get(x) for x in e[:2]) for e in edges]
    whole = [e for e in ends if None not in e]
    df = analytics.edge_quality(g.nodes, g.edges)
    got = df.first()
    assert (got.edges, got.broken, got.self_loops, got.duplicates) == (400, 400 - len(whole), sum(a == b for a, b in whole), len(whole) - len(set(whole)))
    assert f", {-(-len({e[:2] for e in edges}) // 16)}), REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("reverse", [False, True])
def test_file_dependencies_parts(spark, monkeypatch, reverse):
    nodes, edges, g = supply(spark)
    ask = lambda: traverse.file_dependencies(g.nodes, g.edges, g.nodes.select(g.nodes.id.alias("subject")), 3, reverse)
    whole = sorted(ask().collect())
    monkeypatch.setattr(session.dealt, "__kwdefaults__", {"most": 16})
    got = ask()
    assert sorted(got.collect()) == whole and whole
    assert parts(got) == -(-sum(e[2] != "contains" for e in edges) // 16)
