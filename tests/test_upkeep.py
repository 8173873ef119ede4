"""Communities by modularity, reuse of builds, nested ignore files, records, vaults and snapshots."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from codeloom.exports import records, vaults
from codeloom.operators import analytics, community, modularity, snapshot, status
from codeloom.operators.graph import Graph, file_projection
from codeloom.plans import build as B
from codeloom.plans import reuse
from codeloom.plans.engine import Engine
from codeloom.sources.extract import go_module
from codeloom.sources.graph_json import read_graphs, read_registry
from codeloom.sources.repo_scan import scan
from codeloom.streaming.watch import rebuilding

EDGE = "src string, dst string, relation string"


def clique(names):
    return [(a, b, "x") for i, a in enumerate(names) for b in names[i + 1 :]]


def test_modularity_partition(spark):
    groups = ["abcde", "fghij", "klmno"]
    edges = [e for g in groups for e in clique(g)] + [("a", "f", "x"), ("f", "a", "y"), ("j", "k", "x"), ("a", "a", "x"), ("a", "gone", "x")]
    nodes = spark.createDataFrame([(c, c, k, 0) for k, c in enumerate("abcdefghijklmnoz")], "id string, label string, ord long, community int")
    e = spark.createDataFrame(edges, EDGE)
    found = modularity.partition(nodes, e)
    of = {r.id: r.label for r in found.collect()}
    assert len(of) == 16 and of["z"] == "z" and len(set(of.values())) == 4
    assert all(len({of[c] for c in g}) == 1 for g in groups)
    placed = community.apply_communities(nodes, community.numbered(found))
    assert analytics.modularity(placed, e).first()[0] > 0.5
    alone = modularity.partition(nodes, e.where("false"))
    assert all(r.id == r.label for r in alone.collect()) and alone.count() == 16
    assert modularity.partition(nodes.where("false"), e).count() == 0


def test_nested_ignore_files(spark, tmp_path):
    for name, text in {"a.py": "1", "web/keep.ts": "1", "web/gen/x.ts": "1", "web/sub/gen/y.ts": "1", "gen/z.py": "1", "web/.gitignore": "gen/\n", "web/sub/.codeloomignore": "*.dat\n", "web/sub/n.dat": "1", "n.dat": "1"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    assert {r.path for r in scan(spark, str(tmp_path)).select("path").collect()} == {"a.py", "web/keep.ts", "gen/z.py", "n.dat"}


def test_reuse(spark, tmp_path):
    root, kept = tmp_path / "shop", tmp_path / "out"
    (root / ".git").mkdir(parents=True)
    (root / "go.mod").write_text("// top\nmodule example.org/shop\n")
    (root / "lib").mkdir()
    (root / "lib" / "lib.go").write_text("package lib\n\nfunc Load() {\n}\n")
    (root / "main.go").write_text('package main\n\nimport "example.org/shop/lib"\n\nfunc main() {\n\tlib.Load()\n}\n')
    told = []
    b = B.Builder(spark, cluster=lambda g: g.nodes.select("id", F.lit(0).alias("community")))
    run = rebuilding(b, str(root), str(kept), str(tmp_path / "registry.json"), told.append)
    run(spark.range(0), 0)
    assert not kept.exists()
    run(spark.range(1), 1)
    assert told == [] and [r.repo_root for r in read_registry(spark, str(tmp_path / "registry.json")).collect()] == [str(root)]
    saved = reuse.read_build(spark, str(kept))
    # the import reaches the folder's representative through the module's path
    assert ("shop:file:main.go", "shop:file:lib/lib.go") in {(r.src, r.dst) for r in saved.graph.edges.where("relation = 'depends_on'").collect()}
    request = B.BuildRequest(str(root))
    assert b.run(request, saved).mode == "reused"
    other = reuse.Saved(saved.graph, saved.manifest, saved.version, "others", saved.written)
    out = b.run(request, other)
    assert (out.mode, out.refused) == ("full_rebuild", "the extractors are others")
    listing = saved.manifest
    assert reuse.refusal(None, False, listing) == "nothing saved" and reuse.refusal(saved, True, listing).startswith("filters")
    assert reuse.refusal(reuse.Saved(saved.graph, listing, 0, saved.fingerprint), False, listing).startswith("the manifest")
    assert reuse.refusal(reuse.Saved(saved.graph, listing, fingerprint=saved.fingerprint, written=1.0), False, listing).startswith("the code")
    later = listing.withColumn("mod_time", F.lit(datetime(2100, 1, 1)))
    assert reuse.refusal(saved, False, later).startswith("files are newer")
    (kept / "head.json").write_text("{")
    assert reuse.read_build(spark, str(kept)) is None and reuse.read_build(spark, str(tmp_path / "none")) is None
    assert go_module(spark.createDataFrame([], "path string, content string")) == ""


def test_documents_with_bad_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"nodes": [{"id": "a", "label": "A", "kind": "file"}], "edges": []}))
    (tmp_path / "b.json").write_text('{"nodes": [')
    told = []
    g = read_graphs(spark, [str(tmp_path / n) for n in ("a.json", "b.json", "none.json")], told)
    assert [r.label for r in g.nodes.collect()] == ["A"] and len(told) == 2
    with pytest.raises(ValueError):
        read_graphs(spark, [str(tmp_path / "b.json")])


def test_records(spark, tmp_path):
    path = str(tmp_path / "r" / "registry.json")
    records.track(spark, path, "/x/b/", "", "", "/x/b/out/graph.json")
    records.track(spark, path, "/x/a", "zed", "git@h:a", "/x/a/out/graph.json")
    records.track(spark, path, "/x/b", "bee", "", "/x/b/new/graph.json")
    rows = [(r.name, r.repo_root, r.manifest_path) for r in read_registry(spark, path).collect()]
    assert rows == [("bee", "/x/b", "/x/b/new/manifest.json"), ("zed", "/x/a", "/x/a/out/manifest.json")]
    with pytest.raises(ValueError):
        records.track(spark, path, " ", "", "", "g")
    cache = str(tmp_path / "cache.json")
    records.write_cache(spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string"), cache)
    assert {tuple(r) for r in records.read_cache(spark, cache).collect()} == {("p", "1"), ("q", "2")}
    (tmp_path / "cache.json").write_text("[1")
    assert records.read_cache(spark, cache).count() == 0 and records.read_cache(spark, cache + "x").count() == 0
    at = datetime(2024, 5, 1, 10, 0, 0, tzinfo=UTC)
    names = [records.write_history(spark.sql("select 1 nodes, 0.5D rate"), str(tmp_path / "h"), at) for _ in range(3)]
    assert [n.rsplit("/", 1)[-1] for n in names] == ["bench-20240501T100000Z.json", "bench-20240501T100000Z-1.json", "bench-20240501T100000Z-2.json"]
    assert records.last_history(str(tmp_path / "h")) == names[-1] and records.last_history(str(tmp_path / "none")) is None


def test_vaults(spark, tmp_path):
    cols = "id string, label string, kind string, file string, source_type string, source_id string, source_name string, organization string, description string, workspace string, ord long"
    rows = [("project:p", "p", "project", "", "codebase", "p", "p", "acme/x", "", "", 1), ("p:file:a", "a", "file", "a", "codebase", "p", "p", "acme/x", "", "", 2), ("project:q", "q", "project", "", "codebase", "q", "q", "", "", "", 3), ("memory:observation:1", "o", "observation", "", "memory", "", "", "", "", "w2", 4), ("w", "w1", "workspace", "", "memory", "", "", "", "", "", 5)]
    g = Graph(spark.createDataFrame(rows, cols), spark.createDataFrame([("project:p", "a", "contains", 1), ("project:p", "project:q", "uses", 2), ("memory:observation:1", "p:file:a", "documents", 3)], EDGE + ", ord long"))
    assert [tuple(r) for r in vaults.organizations(g.nodes).collect()] == [("acme/x", "Organizations/acme/x")]
    base, own = vaults.organization_graph(g, ""), vaults.organization_graph(g, "acme/x")
    assert {r.id for r in base.nodes.collect()} == {"project:q", "memory:observation:1", "w"} and base.edges.count() == 0
    assert {r.relation for r in own.edges.collect()} == {"contains", "documents"}
    assert vaults.write_vaults(g, str(tmp_path)) == {str(tmp_path): 3, str(tmp_path / "Organizations/acme/x"): 4}
    assert {r.workspace for r in vaults.workspaces(g.nodes).collect()} == {"w1", "w2"} and vaults.project_dirs(g.nodes).count() == 2


def test_snapshot(spark, tmp_path):
    hooks = tmp_path / ".git" / "hooks"
    hooks.mkdir(parents=True)
    assert snapshot.hook_state(str(tmp_path)) == "missing" and snapshot.hook_state("") == "path unavailable"
    (hooks / "post-commit").write_text("codeloom update")
    assert snapshot.hook_state(str(tmp_path)) == "partial"
    (hooks / "post-checkout").write_text("codeloom update")
    m = spark.createDataFrame([("cover", 0.9), ("build", 2500.0)], "metric string, value double")
    limits = spark.createDataFrame([("cover", 0.99, None), ("build", None, 2000.0), ("gone", 1.0, None)], "metric string, least double, most double")
    assert [(r.rank, r.metric) for r in snapshot.shortfalls(status.gates(m, limits)).orderBy("rank").collect()] == [(1, "gone"), (2, "build"), (3, "cover")]
    before = spark.createDataFrame([("cover", 0.8), ("old", 1.0)], "metric string, value double")
    assert {r.metric: (r.improved, r.regressed) for r in snapshot.compared(m, before).collect()} == {"cover": (True, False), "build": (False, False), "old": (False, False)}
    nodes = spark.createDataFrame([("project:p", "p", "project", "", "p", 0, 1)], "id string, label string, kind string, file string, source_id string, community int, ord long")
    edges = spark.createDataFrame([], EDGE + ", confidence string, ord long")
    f = spark.sql("select 'a' path, 3L size, timestamp'2024-01-02' mod_time")
    s = snapshot.snapshot(Graph(nodes, edges), f, f, str(tmp_path))
    assert (s.metrics.first().nodes, s.freshness.first().fresh, s.projects.count(), s.members.count(), s.hooks) == (1, True, 1, 0, "installed")


def test_files_of_nodes_and_requests(spark):
    cols = "id string, label string, kind string, file string, layer string, source_name string, description string, ord long"
    rows = [("s:file:a.go", "other", "file", "", "repo", "s", "", 1), ("s:file:b.go", "b.go", "file", "", "repo", "s", "", 2), ("x", "X", "func", "a.go", "repo", "s", "", 3), ("y", "Y", "func", "b.go", "repo", "", "", 4), ("s:file:c.go", "c.go", "file", "", "repo", "s", "", 5)]
    nodes = spark.createDataFrame(rows, cols)
    edges = spark.createDataFrame([("x", "y", "calls", "", 1), ("s:file:c.go", "x", "mentions", "", 2), ("x", "s:file:b.go", "reads", "", 3), ("s:file:a.go", "s:file:b.go", "depends_on", "", 4)], EDGE + ", confidence string, ord long")
    g = Graph(nodes, edges)
    # by source name and file, though its label is another; by label where there is no source name
    assert ("s:file:a.go", "s:file:b.go") in {(r.src, r.dst) for r in file_projection(g).collect()}
    e = Engine(g)
    # c.go reaches b.go only over a symbol, which is no file dependency
    assert {r.id: r.hops for r in e.impacted("s:file:b.go").collect()} == {"x": 1, "s:file:a.go": 1}
    assert e.find("X") == "x" and e.find("") is None and e.find("c.g") == "s:file:c.go" and e.find("zzzz") is None
    assert "explain" in e.query("help").first().message
