"""The distance index and strong components against plain searches on random graphs."""

import random
from collections import deque

import pytest

from codeloom.operators import reach_index as R
from codeloom.operators import traverse as V

EDGE = "src string, dst string"


def graph(seed, n=30, m=55):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [("n1", "n1"), ("lone", "lone"), ("n0", "n1"), ("n0", "n1")]


def hops_from(edges, start):
    out, todo = {start: 0}, deque([start])
    while todo:
        a = todo.popleft()
        for x, y in edges:
            if x == a and y not in out:
                out[y] = out[a] + 1
                todo.append(y)
    return out


@pytest.mark.parametrize("seed,first,growth", [(1, 64, 64), (2, 1, 3)])
def test_distances_and_paths(spark, seed, first, growth):
    edges = graph(seed)
    df = spark.createDataFrame(edges, EDGE)
    labels = R.distance_labels(df, first, growth).cache()
    ids = sorted({x for e in edges for x in e})
    want = {(a, b): h for a in ids for b, h in hops_from(edges, a).items()}
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids] + [("n1", "gone")], EDGE)
    assert {(r.src, r.dst): r.hops for r in R.distances(labels, pairs).collect()} == want
    some = spark.createDataFrame([("n3",), ("n7",), ("gone",)], "subject string")
    for reverse in (False, True):
        got = {(r.subject, r.id): r.hops for r in R.all_from(labels, some, reverse).collect()}
        assert got == {((b, a) if reverse else (a, b)): h for (a, b), h in want.items() if (b if reverse else a) in ("n3", "n7") and a != b}
    for a, b in random.Random(seed).sample([(a, b) for a in ids for b in ids], 4):
        assert R.path(labels, df, a, b).collect() == V.shortest_path(df, a, b).collect()
    assert R.verdict(labels, "gone", "n1") == "unknown source" and R.verdict(labels, "n1", "gone") == "unknown target"
    assert R.verdict(labels, "lone", "n1") == "apart" and R.verdict(labels, "n0", "n1") == "path"


@pytest.mark.parametrize("seed", [3, 4])
def test_strong_components(spark, seed):
    edges = graph(seed, 24, 44)
    df = spark.createDataFrame(edges, EDGE)
    ids = sorted({x for e in edges for x in e})
    reach = {a: set(hops_from(edges, a)) for a in ids}
    want = {a: min(b for b in ids if b in reach[a] and a in reach[b]) for a in ids}
    found = R.strong_components(df)
    assert {r.id: r.component for r in found.collect()} == want
    above = {(r.src, r.dst) for r in R.condensed(df, found).collect()}
    assert above == {(want[a], want[b]) for a, b in edges if want[a] != want[b]}
    assert R.strong_components(df.limit(0)).count() == 0 and R.distance_labels(df.limit(0)).count() == 0


def test_labels_end_at_earlier_hubs(spark):
    """Sources and sinks around one node: each is labelled by that node and itself alone, not by those on the other side, in one batch too."""
    edges = [(f"a{k}", "mid") for k in range(6)] + [("mid", f"b{k}") for k in range(6)]
    df = spark.createDataFrame(edges, EDGE)
    labels = R.distance_labels(df).cache()
    assert labels.count() == 2 * 13 + 12
    assert {(r.src, r.hops) for r in R.distances(labels, spark.createDataFrame([("a0", "b5"), ("mid", "b5"), ("b5", "a0")], EDGE)).collect()} == {("a0", 2), ("mid", 1)}
