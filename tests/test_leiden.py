"""Leiden against brute force: connected communities, modularity, a seed's communities."""

import random
from itertools import combinations

import pytest

from codeloom.operators import modularity

EDGE = "src string, dst string"


def _frames(spark, n, pairs):
    return spark.createDataFrame([(f"v{i}",) for i in range(n)], "id string"), spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in pairs], EDGE)


def _modularity(pairs, of):
    """By its definition, over all pairs of nodes."""
    links = {frozenset(p) for p in pairs if p[0] != p[1]}
    degree: dict[str, int] = {}
    for p in links:
        for v in p:
            degree[v] = degree.get(v, 0) + 1
    m = len(links)
    q = sum(1 for p in links if len({of[v] for v in p}) == 1) / m
    for label in set(of.values()):
        q -= (sum(k for v, k in degree.items() if of[v] == label) / (2 * m)) ** 2
    return q


def _connected(pairs, members):
    seen, todo = set(), [next(iter(members))]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [y for p in pairs for x, y in (p, p[::-1]) if x == v and y in members]
    return seen == members


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    groups = [r.randrange(5) for _ in range(40)]
    pairs = [(a, b) for a, b in combinations(range(40), 2) if r.random() < (0.5 if groups[a] == groups[b] else 0.04)] + [(3, 3), (0, 1), (1, 0)]
    nodes, edges = _frames(spark, 42, pairs)
    labels = modularity.leiden(nodes, edges, seed)
    of = {r.id: r.label for r in labels.collect()}
    named = [(f"v{a}", f"v{b}") for a, b in pairs]
    assert set(of) == {f"v{i}" for i in range(42)} and of["v40"] == "v40" and of["v41"] == "v41"
    for label in set(of.values()):
        assert _connected(named, {v for v in of if of[v] == label})
    before = {r.id: r.label for r in modularity.partition(nodes, edges).collect()}
    q = _modularity(named, of)
    assert q > 0.3 and q >= _modularity(named, before) - 0.01
    assert modularity.modularity_of(nodes, edges, labels) == pytest.approx(q)
    assert modularity.loose_communities(nodes, edges, labels).isEmpty()


def test_cliques_and_a_split_community(spark):
    ring = [(5 * c + a, 5 * c + b) for c in range(6) for a, b in combinations(range(5), 2)] + [(5 * c, (5 * c + 5) % 30) for c in range(6)]
    nodes, edges = _frames(spark, 30, ring)
    of = {r.id: r.label for r in modularity.leiden(nodes, edges).collect()}
    assert {frozenset(v for v in of if of[v] == label) for label in of.values()} == {frozenset(f"v{5 * c + i}" for i in range(5)) for c in range(6)}
    two = spark.createDataFrame([(f"v{i}", "one" if i < 10 else f"v{i}") for i in (*range(5), *range(10, 15), 5, 6, 7, 8, 9)], "id string, label string")
    assert modularity.loose_communities(nodes, edges, two).isEmpty()
    apart = two.selectExpr("id", "CASE WHEN label = 'one' AND id IN ('v1', 'v6') THEN 'x' ELSE label END AS label")
    assert [r.label for r in modularity.loose_communities(nodes, edges, apart).collect()] == ["x"]


def test_nothing_to_divide(spark):
    nodes, none = _frames(spark, 3, [(0, 0)])
    assert {tuple(r) for r in modularity.leiden(nodes, none).collect()} == {("v0", "v0"), ("v1", "v1"), ("v2", "v2")}
    assert modularity.leiden(nodes.limit(0), none).isEmpty() and modularity.modularity_of(nodes, none, nodes.selectExpr("id", "id AS label")) == 0.0
