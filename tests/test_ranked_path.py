"""Ranked file paths against listing all simple paths."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import traverse as V

PATHS = ["cmd/app/main.go", "packages/api/src/index.ts", "packages/api/src/domain/x.ts", "internal/config/config.go", "packages/api/context/a.ts", "pkg/types/types.go", "packages/api/b.ts", "lib/plain.go"]


def listed(edges, source, target):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found, todo = [], [[source]]
    while todo:
        p = todo.pop()
        if p[-1] == target:
            found.append(p)
        elif len(p) < 8:
            todo += [[*p, x] for x in out.get(p[-1], ()) if x not in p]
    short = min(map(len, found), default=0)
    return [p for p in found if len(p) <= min(short + 3, 8)]


@pytest.mark.parametrize("seed,n,m", [(1, 9, 30), (2, 14, 45), (3, 7, 30), (4, 12, 20)])
def test_equals_listing(spark, seed, n, m):
    rng = random.Random(seed)
    ids = [f"n{k:02}" for k in range(n)]
    file = {x: rng.choice(PATHS) for x in ids}
    edges = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(m)})
    nodes = spark.createDataFrame([(x, "file", file[x]) for x in ids], "id string, kind string, file string")
    links = spark.createDataFrame([(a, b, "depends_on") for a, b in edges], "src string, dst string, relation string")
    for source, target in [(ids[0], ids[1]), (ids[2], ids[0])]:
        paths = listed(edges, source, target)
        got = [r.id for r in V.ranked_file_path(nodes, links, source, target).orderBy("hop").collect()]
        if not paths:
            assert got == []
            continue
        scored = spark.createDataFrame([(p, [file[x] for x in p]) for p in paths], "ids array<string>, files array<string>").select("ids", V.path_score(F.col("files")).alias("s")).collect()
        best = min(scored, key=lambda r: (-r.s, len(r.ids), r.ids))
        assert got == best.ids, (source, target)


def test_walks_that_turn_back_are_not_taken(spark):
    """The best walk goes to and fro between two files that count much; the best path cannot."""
    file = {"s": "cmd/a/main.go", "i": "packages/p/src/index.ts", "j": "packages/p/src/index.tsx", "t": "packages/p/z.ts", "k": "lib/k.go"}
    edges = [("s", "i"), ("i", "j"), ("j", "i"), ("i", "t"), ("j", "k"), ("k", "t"), ("s", "t")]
    nodes = spark.createDataFrame([(x, "file", f) for x, f in file.items()], "id string, kind string, file string")
    links = spark.createDataFrame([(a, b, "depends_on") for a, b in edges], "src string, dst string, relation string")
    paths = listed(edges, "s", "t")
    scored = spark.createDataFrame([(p, [file[x] for x in p]) for p in paths], "ids array<string>, files array<string>").select("ids", V.path_score(F.col("files")).alias("s")).collect()
    best = min(scored, key=lambda r: (-r.s, len(r.ids), r.ids))
    assert [r.id for r in V.ranked_file_path(nodes, links, "s", "t").orderBy("hop").collect()] == best.ids
    assert [r.id for r in V.ranked_file_path(nodes, links, "s", "s").collect()] == ["s"]
