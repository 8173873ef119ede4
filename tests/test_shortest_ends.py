"""The shortest path from both ends against a plain search; a wide end is not searched through."""

import random

from codeloom.operators import traverse


def _plain(edges, a, b):
    paths = [[a]]
    seen = {a}
    while paths:
        done = sorted(p for p in paths if p[-1] == b)
        if done:
            return done[0]
        grown = [p + [y] for p in paths for x, y in edges if x == p[-1] and y not in seen]
        seen |= {p[-1] for p in grown}
        best = {}
        for p in grown:
            best[p[-1]] = min(best.get(p[-1], p), p)
        paths = list(best.values())
    return []


def test_path_from_both_ends(spark, monkeypatch):
    rng = random.Random(8)
    edges = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(45)}
    df = spark.createDataFrame(sorted(edges), "src string, dst string").coalesce(1)
    for a, b in (("n1", "n9"), ("n3", "n17")):
        assert [r.id for r in traverse.shortest_path(df, a, b).orderBy("hop").collect()] == _plain(edges, a, b)
    wide = [("s", f"w{k}") for k in range(50)] + [(f"w{k}", f"x{k}") for k in range(50)] + [("x7", "t")]
    sizes, real = [], traverse.scratch

    def counted(df, name):
        out = real(df, name)
        sizes.extend([out.count()] * (name == "path"))
        return out

    monkeypatch.setattr(traverse, "scratch", counted)
    got = traverse.shortest_path(spark.createDataFrame(wide, "src string, dst string").coalesce(1), "s", "t")
    assert [r.id for r in got.orderBy("hop").collect()] == ["s", "w7", "x7", "t"] and sum(x >= 50 for x in sizes) == 1
