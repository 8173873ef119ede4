"""Builds of small repositories with fake drivers."""

import pytest

from codeloom.plans import build as B
from codeloom.plans.engine import Engine

FILES = {"go.mod": "module m\n", "a.go": "package m\n\nfunc Main() {\n\tLoad()\n}\n", "b.go": "package m\n\nfunc Load() {\n}\n", "c.go": "package m\n\nfunc Lone() {\n}\n"}


def tree(root, names):
    root.mkdir(parents=True, exist_ok=True)
    (root / ".git").mkdir(exist_ok=True)
    for n in names:
        (root / n).write_text(FILES[n])


def test_build(spark, tmp_path):
    root = tmp_path / "shop"
    tree(root, FILES)
    facts = lambda s, r: s.createDataFrame([("shop:a.go:Main", "ext:db", "references", [("scip", "go", "declared", "x")], 1)], B.FACTS)

    def broken(s, r):
        raise RuntimeError("no indexer")

    seen = []
    drivers = [B.Driver("go", ("go",), facts), B.Driver("bad", ("go",), broken), B.Driver("py", ("python",), broken)]
    b = B.Builder(spark, drivers, {"same": lambda f: f}, observer=lambda s, st: seen.append(s), persist=lambda r: None)
    out = b.run(B.BuildRequest(str(root)))
    assert out.warnings == ["driver bad: no indexer"]
    assert list(dict.fromkeys(seen)) == [*B.STAGES] and ("cluster", "done", 1) in B.summarized(out.stages)
    edges = {(r.src, r.relation, r.dst) for r in out.graph.edges.collect()}
    assert ("shop:a.go:Main", "calls", "shop:b.go:Load") in edges and ("shop:file:a.go", "depends_on", "shop:file:b.go") in edges and ("shop:a.go:Main", "references", "ext:db") in edges
    assert "shop:a.go:Main" in {r.id for r in Engine(out.graph).search("who uses Load").collect()}
    again = b.run(B.BuildRequest(str(root)), (out.graph, out.manifest))
    assert again.mode == "reused"
    (root / "c.go").unlink()
    less = b.run(B.BuildRequest(str(root)), (out.graph, out.manifest))
    assert less.mode == "deleted_only_prune" and less.graph.nodes.where("file = 'c.go'").count() == 0 and less.graph.nodes.where("file = 'a.go'").count() == 2
    with pytest.raises(ValueError):
        b.run(B.BuildRequest(str(root), patchers=("nope",)))


def test_repositories(spark, tmp_path):
    tree(tmp_path / "one", ["go.mod", "a.go"])
    tree(tmp_path / "two", ["go.mod", "b.go"])
    assert [p.rsplit("/", 1)[-1] for p in B.child_repositories(str(tmp_path))] == ["one", "two"]
    out = B.Builder(spark, cluster=lambda g: 1 / 0).run_all(str(tmp_path))
    assert {r.id for r in out.graph.nodes.where("kind = 'project'").collect()} == {"project:one", "project:two"}
    assert [w.split(":")[0] for w in out.warnings] == ["one", "two"] and {r.path for r in out.manifest.collect()} == {"one/a.go", "two/b.go"}
    assert B.stack_of(str(tmp_path / "one")) == "go" and B.identity_of(str(tmp_path / "one")) == ("one", "one")
    (tmp_path / "graph.json").write_text("{}")
    assert B.find_graph(str(tmp_path / "one")) == str(tmp_path / "graph.json")
