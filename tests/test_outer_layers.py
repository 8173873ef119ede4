"""Outer nodes of the distance index refer to their neighbours: rows in proportion to the edges, and the same answers."""

import random
from collections import deque

import pytest

from codeloom.operators import reach_index as R
from codeloom.operators import traverse as V

EDGE = "src string, dst string"


def hops_from(edges, start):
    out, todo = {start: 0}, deque([start])
    while todo:
        a = todo.popleft()
        for x, y in edges:
            if x == a and y not in out:
                out[y] = out[a] + 1
                todo.append(y)
    return out


def layered(seed):
    """Two chains of sources and two of sinks of different lengths around a ring, ways past the ring, parallel and self edges, an edge apart."""
    rng = random.Random(seed)
    ring = [(f"c{k}", f"c{(k + 1) % 4}") for k in range(4)]
    into = [("p0", "p1"), ("p1", "p2"), ("p2", "p3"), ("p3", "p4"), ("p4", "c0"), ("q0", "c2"), ("q0", "p3")]
    out = [("c1", "s4"), ("s4", "s3"), ("s3", "s2"), ("s2", "s1"), ("s1", "s0"), ("c3", "t0"), ("s3", "t0")]
    past = [("p2", "s2"), ("q0", "t0"), ("p0", "s0")]
    more = [(rng.choice("pq") + str(rng.randrange(3)), rng.choice("st") + str(rng.randrange(3))) for _ in range(3)]
    return ring + into + out + past + more + [("c0", "c1"), ("s0", "s0"), ("lone", "lone"), ("x", "y")]


@pytest.mark.parametrize("seed,layers", [(1, 3), (2, 1)])
def test_answers_through_outer_layers(spark, monkeypatch, seed, layers):
    monkeypatch.setattr(R, "LAYERS", layers)
    edges = layered(seed)
    df = spark.createDataFrame(edges, EDGE)
    labels = R.distance_labels(df).cache()
    assert labels.agg({"dir": "max"}).first()[0] in (2 * layers, 2 * layers + 1)
    ids = sorted({x for e in edges for x in e})
    want = {(a, b): h for a in ids for b, h in hops_from(edges, a).items()}
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids], EDGE)
    assert {(r.src, r.dst): r.hops for r in R.distances(labels, pairs).collect()} == want
    subjects = spark.createDataFrame([(x,) for x in ids], "subject string")
    for reverse in (False, True):
        got = {(r.subject, r.id): r.hops for r in R.all_from(labels, subjects, reverse).collect()}
        assert got == {((b, a) if reverse else (a, b)): h for (a, b), h in want.items() if a != b}
    for a, b in (("p0", "s0"), ("x", "s0")):
        assert R.path(labels, df, a, b).collect() == V.shortest_path(df, a, b).collect()


def test_rows_follow_the_edges(spark):
    """Parents of a ring, their children and the children's own: each edge outside the ring is one row, where labels were as many as ancestors."""
    ring = [("r0", "r1"), ("r1", "r0")]
    tree = [(f"r{k % 2}", f"a{k}") for k in range(5)] + [(f"a{k % 5}", f"b{k}") for k in range(20)] + [(f"b{k % 20}", f"z{k % 7}") for k in range(60)]
    labels = R.distance_labels(spark.createDataFrame(ring + tree, EDGE))
    n = 2 + 5 + 20 + 7
    assert labels.count() == 2 * n + len(set(tree)) + len(ring)
