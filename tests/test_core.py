"""The graph operators on small literal graphs."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.exports import documents, vault
from codeloom.functions import identity as I
from codeloom.functions import text as T
from codeloom.operators import analytics, binding, community, ignore, lookup, manifest, traverse, workspace
from codeloom.operators import graph as G
from codeloom.plans.engine import Engine, NotFound, rendered
from codeloom.plans.router import QueryRequest, parse_question, routed
from codeloom.sources import contracts, extract, graph_json, repo_scan
from codeloom.streaming import watch

NODE = "id string, label string, kind string, file string, layer string, source_name string, source_id string, organization string, description string, community int, ord long"
EDGE = "src string, dst string, relation string, confidence string, score double, file string, projected_from string, ord long"


def graph(spark, nodes, edges):
    n = [(r + ("",) * 4)[:4] for r in nodes]
    full = [(i, label, kind, file, "repo", "shop", "shop", "org", "", 0, k) for k, (i, label, kind, file) in enumerate(n)]
    e = [((r + ("",) * 3)[:4], k) for k, r in enumerate(edges)]
    return G.Graph(spark.createDataFrame(full, NODE), spark.createDataFrame([(s, d, rel, conf, 0.0, "", "", k) for (s, d, rel, conf), k in e], EDGE))


@pytest.fixture(scope="module")
def requests(spark):
    return graph(
        spark,
        [("api", "APIHandler", "handler"), ("auth", "AuthService", "struct"), ("db", "Database", "struct"), ("user", "UserRepo", "struct")],
        [("api", "auth", "calls"), ("auth", "db", "depends_on"), ("auth", "user", "depends_on"), ("user", "db", "depends_on")],
    )


def test_requests(spark, requests):
    e = Engine(requests)
    run = lambda *a, **k: [r.asDict() for r in e.run(QueryRequest(*a, **k)).collect()]
    assert [r["id"] for r in run("dependencies", "AuthService")] == ["db", "user"]
    assert [r["id"] for r in run("dependencies", "api", limit=2)] == ["auth", "db"]
    assert [r["id"] for r in run("reverse_dependencies", "Database")] == ["auth", "user", "api"]
    assert {(r["id"], r["hops"]) for r in run("impact", "db")} == {("auth", 1), ("user", 1), ("api", 2)}
    assert [r["id"] for r in run("path", "APIHandler", "Database")] == ["api", "auth", "db"]
    assert run("path", "db", "api") == [] and run("path", "db", "db") == [{"hop": 0, "id": "db"}]
    lines = [r["line"] for r in run("explain", "AuthService")]
    assert "APIHandler [repo/handler] --[calls]--> AuthService [repo/struct] {layer=repo" not in lines[0] and any("APIHandler" in x for x in lines) and len(lines) == 3
    assert [r.id for r in e.search("who uses Database").collect()] == ["auth", "user", "api"]
    assert e.query("nodes").first()[0] == 4
    with pytest.raises(NotFound):
        e.run(QueryRequest("impact", "Ghost"))
    with pytest.raises(ValueError):
        QueryRequest("path", "a").checked()
    assert rendered("x:", []) == "x:\n  (none)"


PROMPTS = [
    ("who uses rootCmd", ("reverse_dependencies", "rootCmd", "")),
    ("where is internal/query/query.go used?", ("reverse_dependencies", "internal/query/query.go", "")),
    ("what does loadEngine depend on", ("dependencies", "loadEngine", "")),
    ("what breaks if loadEngine changes?", ("impact", "loadEngine", "")),
    ("path rootCmd -> graphQueryCmd", ("path", "rootCmd", "graphQueryCmd")),
    ("how does rootCmd reach graphQueryCmd?", ("path", "rootCmd", "graphQueryCmd")),
    ("explain `rootCmd`", ("explain", "rootCmd", "")),
    ("path from A to B", ("path", "A", "B")),
    ("path Auto -> B", ("path", "Auto", "B")),
    ("find the TODO comment", None),
]


def test_questions(spark):
    df = spark.createDataFrame([(q,) for q, _ in PROMPTS], "q string").select("q", routed(F.col("q")).alias("r"))
    got = {r.q: tuple(r.r) if r.r else None for r in df.collect()}
    for q, want in PROMPTS:
        assert got[q] == want
        if want:
            r = parse_question(q)
            assert (r.kind, r.subject, r.target) == want and r.limit == 20
        else:
            with pytest.raises(ValueError):
                parse_question(q)


def test_cleaning(spark):
    g = graph(spark, [("a", "Foo", "function"), ("a", "Other", "function"), ("b", "Bar", "function"), ("", "x", "function")], [("a", "Bar", "calls"), ("a", "Bar", "calls"), ("a", "external", "calls"), ("ghost", "b", "calls"), ("b", "b", "calls"), ("a", "", "calls")])
    c = g.canonicalized()
    assert {r.id: r.label for r in c.nodes.collect()} == {"a": "Foo", "b": "Bar"}
    assert c.edges.count() == 3
    again = c.canonicalized()
    assert sorted(map(tuple, again.nodes.collect())) == sorted(map(tuple, c.nodes.collect())) and again.edges.count() == 3
    assert [(r.src, r.dst, r.dst_raw, r.dst_label) for r in g.built().edges.collect()] == [("a", "b", "Bar", "Bar")]


def test_resolution_prefers_layer(spark):
    g = graph(spark, [("contract:service:billing", "billing", "service"), ("workspace:service:billing", "billing", "service"), ("memory:observation:7", "Note", "observation")], [])
    nodes = g.nodes.withColumn("layer", F.substring_index("id", ":", 1))
    refs = spark.createDataFrame([("billing", "workspace"), ("billing", "contract"), (f"{I.OBSERVATION}7", ""), ("NOTE", ""), ("none", "")], "ref string, layer string")
    every = {(r.id, r.tier) for r in G.resolve_all(nodes, refs.limit(1)).collect()}
    assert every == {("contract:service:billing", 3), ("workspace:service:billing", 3)}
    one = {(r.ref, r.id) for r in G.resolve_one(nodes, refs.where("layer <> 'contract'")).collect()}
    assert one == {("billing", "workspace:service:billing"), (f"{I.OBSERVATION}7", "memory:observation:7"), ("NOTE", "memory:observation:7")}


def test_contract_merge(spark):
    ours = graph(spark, [("a", "A", "function"), ("b", "B", "function")], [("a", "b", "calls", "EXTRACTED"), ("b", "a", "calls", "INFERRED")])
    theirs = graph(spark, [("a", "renamed", "function"), ("c", "C", "service")], [("a", "b", "calls", "INFERRED"), ("b", "a", "calls", "DECLARED"), ("c", "a", "declares", "DECLARED")])
    m = G.merge_contract(ours, theirs)
    assert {(r.src, r.dst): r.confidence for r in m.edges.collect()} == {("a", "b"): "EXTRACTED", ("b", "a"): "DECLARED", ("c", "a"): "DECLARED"}
    assert {r.id: r.label for r in m.nodes.collect()} == {"a": "A", "b": "B", "c": "C"}


def test_prune_and_manifest(spark):
    g = graph(spark, [("p", "p", "project"), ("r:file:main.go", "main.go", "file", "main.go"), ("r:file:query.go", "query.go", "file", "./query.go"), ("r:query.go:Run", "Run", "function", "query.go")], [("r:file:main.go", "r:query.go:Run", "calls"), ("r:file:query.go", "r:query.go:Run", "contains")])
    out = G.pruned(g, spark.createDataFrame([("query.go",)], "path string"))
    assert out.nodes.count() == 2 and out.edges.count() == 0
    m = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    d = manifest.diff(m([("main.go", "a"), ("query.go", "b")]), m([("main.go", "a")]))
    assert {r.path: r.status for r in d.collect()} == {"main.go": "unchanged", "query.go": "deleted"}
    assert manifest.reuse_mode(d).first().mode == "deleted_only" and manifest.reuse_mode(d, False).first().mode == "none"


def files(spark, paths, edges):
    g = graph(spark, [(f"f:{p}", p, "file", p) for p in paths], [(f"f:{a}", f"f:{b}", "depends_on") for a, b in edges])
    return g


def test_ranked_paths(spark):
    direct = files(spark, ["cmd/main.go", "internal/config/config.go", "pkg/types/types.go"], [("cmd/main.go", "pkg/types/types.go"), ("cmd/main.go", "internal/config/config.go"), ("internal/config/config.go", "pkg/types/types.go")])
    got = [r.id for r in traverse.ranked_file_path(direct.nodes, direct.edges, "f:cmd/main.go", "f:pkg/types/types.go").orderBy("hop").collect()]
    assert got == ["f:cmd/main.go", "f:internal/config/config.go", "f:pkg/types/types.go"]
    p = "packages/api-client/src/"
    app, target = ["apps/web/page.tsx", "apps/web/domain/a.ts", "apps/web/domain/b.ts"], p + "hooks/users/use-users.ts"
    barrels = [p + "index.ts", p + "hooks/index.ts", p + "hooks/users/index.ts"]
    chain = files(spark, [*app, *barrels, target], [*zip(app, [*app[1:], target], strict=True), *zip([app[0], *barrels], [*barrels, target], strict=True)])
    got = [r.id for r in Engine(chain).run(QueryRequest("path", f"f:{app[0]}", f"f:{target}")).orderBy("hop").collect()]
    assert got == [f"f:{x}" for x in [app[0], *barrels, target]]
    assert traverse.ranked_file_path(direct.nodes, direct.edges, "f:pkg/types/types.go", "f:cmd/main.go").count() == 0


def test_barrel_callers(spark):
    index = "packages/api-client/src/index.ts"
    g = files(spark, [index, "packages/api-client/src/inner.ts", "apps/mobile/a.ts", "apps/mobile/b.ts"], [("packages/api-client/src/inner.ts", index), ("apps/mobile/a.ts", index), ("apps/mobile/b.ts", index)])
    got = [r.id for r in Engine(g).run(QueryRequest("reverse_dependencies", index)).collect()]
    assert got == ["f:apps/mobile/a.ts", "f:apps/mobile/b.ts"]


def test_analytics(spark):
    g = graph(spark, [("hub", "hub", "function"), ("mid", "mid", "function"), ("leaf", "leaf", "function"), ("other", "other", "function")], [("hub", "mid", "c"), ("hub", "leaf", "c"), ("hub", "other", "c"), ("mid", "leaf", "c")])
    gods = analytics.god_nodes(g.nodes, g.edges, 9).collect()
    assert gods[0].id == "hub" and len(gods) == 4
    h = graph(spark, [(x, x, "function") for x in "abcd"], [("a", "b", "c"), ("a", "c", "c"), ("b", "d", "c")])
    split = h.nodes.withColumn("community", F.when(F.col("id").isin("a", "b"), 0).otherwise(1))
    assert {(r.src, r.dst) for r in analytics.surprise_edges(split, h.edges).collect()} == {("a", "c"), ("b", "d")}
    asked = analytics.suggested_questions(["only"])
    assert len(asked) == 5 == len(analytics.suggested_questions([]))
    assert asked[1] == "What is the shortest dependency path from only to <node>?"
    none = h.edges.where("false")
    assert analytics.modularity(h.nodes, none).first()[0] == 0.0
    assert analytics.edge_quality(h.nodes, none).first().resolution_rate == 0.0


def test_communities(spark):
    edges = [(a, b, "c") for grp in ("abc", "xyz") for a in grp for b in grp if a < b] + [("c", "x", "c")]
    g = graph(spark, [(x, x, "function") for x in "abcxyzi"], edges)
    labels = community.label_propagation(g.nodes, g.edges)
    of = {r.id: r.community for r in community.numbered(labels).collect()}
    assert set(of) == set("abcxyzi") and list(of.values()).count(of["i"]) == 1
    assert of["a"] == of["b"] == of["c"] and of["x"] == of["y"] == of["z"]
    placed = community.apply_communities(g.nodes, community.numbered(labels))
    alone = g.nodes.withColumn("community", F.row_number().over(Window.orderBy("id")))
    assert analytics.modularity(placed, g.edges).first()[0] > analytics.modularity(alone, g.edges).first()[0]


def test_lookup(spark):
    g = graph(spark, [("auth", "AuthService", "struct"), ("workspace:service:auth", "auth", "service"), ("db", "Database", "struct", "internal/auth/store_test.go")], [])
    got = [(r.id, r.score) for r in lookup.lookup(g.nodes, "auth").collect()]
    assert got == [("auth", 126), ("workspace:service:auth", 126), ("db", 79)]
    assert [r.id for r in lookup.search(g.nodes, "Database", 1).collect()] == ["db"] and lookup.search(g.nodes, " ").count() == 0
    hits = spark.createDataFrame([("q", 1, "a"), ("q", 2, "x")], "case string, position int, label string")
    grades = spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], "case string, label string, grade int")
    r = lookup.ndcg(hits, grades).first()
    assert r.recall == 0.5 and 0.75 < r.ndcg < 0.77


def test_workspace(spark):
    g = graph(spark, [("project:1", "", "project"), ("project:2", "", "project"), ("contract:service:billing", "billing", "service"), ("contract:service:auth", "auth", "service")], [("contract:service:billing", "project:1", "declared_in"), ("contract:service:auth", "project:2", "declared_in")])
    nodes = g.nodes.withColumn("source_name", F.when(F.col("id") == "project:1", "billing-api").when(F.col("id") == "project:2", "auth-api"))
    over = spark.createDataFrame([("Billing-API", "domain", "billing"), ("billing-api", "package", "invoice"), ("billing-api", "dependency", "auth-api"), ("billing-api", "dependency", "ghost-repo"), ("nobody", "domain", "x")], "repo string, term_kind string, term string")
    terms = workspace.repo_terms(nodes, g.edges, over)
    top = workspace.select_repos(terms, ["billing"]).first()
    assert (top.repo, top.score, top.reasons) == ("billing-api", 7.0, ["domain:billing", "name:billing-api", "service:billing"])
    assert [r.repo for r in workspace.select_repos(terms, ["auth"]).collect()] == ["auth-api", "billing-api"]
    assert workspace.select_repos(terms, ["zzz"]).count() == 0 and workspace.select_repos(terms, []).count() == 0
    n, e = workspace.materialized(terms)
    assert {r.id for r in n.collect()} == {f"workspace:{x}" for x in ("repo:billing-api", "repo:auth-api", "service:billing", "service:auth", "package:invoice", "domain:billing")}
    assert {(r.src.split(":")[-1], r.relation, r.dst.split(":")[-1]) for r in e.collect()} == {("billing-api", "exposes", "billing"), ("auth-api", "exposes", "auth"), ("billing-api", "hosts", "invoice"), ("billing-api", "owns", "billing"), ("billing-api", "depends_on", "auth-api")}
    again, _ = workspace.materialized(workspace.loaded(n, e))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, n.collect()))
    assert [r.repo for r in workspace.exposing(terms, "Billing").collect()] == ["billing-api"]


def test_bindings(spark):
    g = graph(spark, [("f1", "a", "file", "internal/auth/service.go"), ("f2", "b", "file", "pkg/auth/service.go"), ("f3", "c", "file", "cmd/main.go"), ("s1", "Run", "function"), ("s2", "Dup", "function"), ("s3", "dup", "method"), ("project:x", "Shop", "project")], [])
    targets = ["repo:file:internal/auth/SERVICE.go", "repo:file:old/main.go", "repo:file:legacy/internal/auth/service.go", "repo:file:auth/service.go", "repo:file:none.go", "repo:file: ", "repo:symbol:run", "repo:symbol:dup", "repo:symbol:zip", "workspace:repo:shop", "concept:x"]
    got = {r.target: (r.state, r.bound_target, r.suggestions) for r in binding.bindings(spark.createDataFrame([(t,) for t in targets], "target string"), g.nodes).collect()}
    assert got == {
        "repo:file:internal/auth/SERVICE.go": ("current", "f1", None), "repo:file:old/main.go": ("redirected", "f3", None), "repo:file:legacy/internal/auth/service.go": ("redirected", "f1", None),
        "repo:file:auth/service.go": ("ambiguous", None, ["f1", "f2"]), "repo:file:none.go": ("stale", None, None), "repo:file: ": ("stale", None, None), "repo:symbol:run": ("current", "s1", None),
        "repo:symbol:dup": ("ambiguous", None, ["s2", "s3"]), "repo:symbol:zip": ("stale", None, None), "workspace:repo:shop": ("current", "project:x", None), "concept:x": ("current", "concept:x", None),
    }
    e = spark.createDataFrame([("o", "repo:symbol:run", "documents", "memory", "reference", ""), ("o", "repo:symbol:dup", "documents", "memory", "reference", ""), ("a", "b", "calls", "repo", "", "")], "src string, dst string, relation string, layer string, evidence_type string, reference_target string")
    bound = {r.reference_target: (r.dst, r.binding_state) for r in binding.bind_references(e, g.nodes).collect()}
    assert bound == {"repo:symbol:run": ("s1", "current"), "repo:symbol:dup": ("repo:symbol:dup", "ambiguous"), None: ("b", None)}


def test_references(spark):
    df = spark.createDataFrame([("Auth decision touches `AuthService` and [[Security]]", "See internal/auth/service.go and internal/auth/service.go. Related to #42 and obs:42.")], "t string, c string")
    got = [tuple(r) for r in df.select(binding.references(F.col("t"), F.col("c"))).first()[0]]
    assert got == [("file", "internal/auth/service.go"), ("function", "AuthService"), ("concept", "Security"), ("observation", "42")]


IGNORED = [
    (["secret.txt"], "secret.txt", False, True), (["secret.txt"], "public.txt", False, False), (["node_modules/"], "node_modules", True, True), (["node_modules/"], "node_modules", False, False), (["*.pyc"], "main.pyc", False, True), (["*.pyc"], "main.py", False, False),
    (["vendor/"], "a/b/vendor", True, True), (["/dist"], "dist", False, True), (["/dist"], "src/dist", False, False), (["*.log", "!important.log"], "important.log", False, False), (["*.log", "!important.log"], "debug.log", False, True), (["# x", "", "  "], "x", False, False),
    (["*.log"], "../a.log", False, False), (["a/**/z"], "a/z", False, True), (["a/**/z"], "a/b/c/z", False, True), (["a/**"], "a/b/c", False, True), (["**/x.go"], "p/q/x.go", False, True), (["x?.go"], "x1.go", False, True), (["x[0-9].go"], "xa.go", False, False),
]


def test_ignore(spark):
    df = spark.createDataFrame([(k, p, d) for k, (_, p, d, _) in enumerate(IGNORED)], "k int, path string, dir boolean")
    for k, (lines, _, _, want) in enumerate(IGNORED):
        got = df.where(F.col("k") == k).select(ignore.ignored(F.col("path"), F.col("dir"), ignore.rules(lines))).first()[0]
        assert got == want, IGNORED[k]
    tree = spark.createDataFrame([("a/node_modules/x/y.js",), ("a/src/y.js",), ("a/src/keep.log",)], "path string")
    out = tree.where(~ignore.ignored_with_parents(F.col("path"), [ignore.default_rules("node"), ignore.rules(["!keep.log"])]))
    assert [r.path for r in out.collect()] == ["a/src/y.js"]


def test_identity(spark):
    df = spark.createDataFrame([("git@github.com:org/sub/name.git",), ("https://github.com/org/name",), ("ssh://git@host.com:22/o/n.git",), ("/local/place/name",)], "u string")
    got = [tuple(r[0]) for r in df.select(I.remote_identity(F.col("u"))).collect()]
    assert got == [("github.com/org/sub/name", "org/sub", "name"), ("github.com/org/name", "org", "name"), ("host.com/o/n", "o", "n"), ("name", "", "name")]
    v = spark.range(1)
    one = lambda c: v.select(c).first()[0]
    assert one(T.safe_path_component(F.lit(". a/b:c ."))) == "a_b_c" and one(T.safe_path_component(F.lit("x" * 200))).startswith("x" * 109 + "-") and one(T.safe_file_name(F.lit(""))) == "_unnamed"
    assert one(T.slug(F.lit("Hello, World! "))) == "hello-world" and one(T.sanitize_label(F.lit("a\x00b\u200b\nc"))) == "abc" and one(T.search_term(F.lit(" `x`? "))) == "x"
    assert one(I.label_of_id(F.lit("a:b:"))) == "a:b:" and one(I.label_of_id(F.lit("a/b/c"))) == "c" and one(I.evidence_weight(F.lit("declared"), F.lit("stale"), F.lit(50.0))) == 4.0


PY = "class Server:\n    def start(self):\n        self.listen()\n    def listen(self):\n        print(1)\n\ndef make():\n    return Server()\nimport pkg.util\n"
GO = 'package main\n\nimport "example.com/m/internal/config"\n\ntype Server struct{}\n\ntype Handler interface {\n\tServe()\n}\n\nfunc New() *Server { return &Server{} }\n\nfunc (s *Server) Start() {\n\tfmt.Println("} ignore(")\n\ts.listen()\n}\n\nfunc (s *Server) listen() {}\n'
TS = "import { x } from './lib';\nimport y from '@w/pkg';\ninterface Logger { log(m: string): void; }\nclass Server {\n  constructor(a: string) { this.b(); }\n  start(): void {\n    this.listen();\n  }\n  private listen(): void { console.log('x'); }\n}\nfunction make(h: string): Server { return new Server(h); }\nconst handle = (r: string): void => {\n  console.log(r);\n};\n"


def test_extraction(spark, tmp_path):
    tree = {"a.py": PY, "pkg/util.py": "x = 1\n", "bad.py": "def (", "main.go": GO, "internal/config/config.go": "package config\n", "internal/config/a.go": "package config\n", "web/app.ts": TS, "web/lib/index.ts": "export function f() {}\n", "lib/package.json": json.dumps({"name": "@w/pkg", "exports": {".": {"source": "./src/main.ts"}}}), "lib/src/main.ts": "export {};\n", "node_modules/z.js": "function z() {}", ".gitignore": "*.gen.go\n", "x.gen.go": "package x"}
    for p, s in tree.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(s)
    scanned = repo_scan.scan(spark, str(tmp_path), "node")
    listed = {r.path for r in scanned.select("path").collect()}
    assert "node_modules/z.js" not in listed and "x.gen.go" not in listed and "a.py" in listed
    g = extract.extracted(scanned, "r", "repo", "example.com/m")
    symbols = {(r.file, r.label, r.kind) for r in g.nodes.where("location <> ''").collect()}
    assert symbols == {
        ("a.py", "Server", "struct"), ("a.py", "start", "function"), ("a.py", "listen", "function"), ("a.py", "make", "function"),
        ("main.go", "Server", "struct"), ("main.go", "Handler", "interface"), ("main.go", "New", "function"), ("main.go", "Start", "method"), ("main.go", "listen", "method"),
        ("web/app.ts", "Logger", "interface"), ("web/app.ts", "Server", "struct"), ("web/app.ts", "start", "method"), ("web/app.ts", "listen", "method"), ("web/app.ts", "make", "function"), ("web/app.ts", "handle", "function"),
        ("web/lib/index.ts", "f", "function"),
    }
    calls = {(r.src, r.dst) for r in g.edges.where("relation = 'calls'").collect()}
    assert calls == {("r:a.py:start", "listen"), ("r:a.py:listen", "print"), ("r:a.py:make", "Server"), ("r:main.go:Start", "Println"), ("r:main.go:Start", "listen"), ("r:web/app.ts:start", "listen"), ("r:web/app.ts:listen", "log")}
    static = {(r.src, r.dst) for r in g.edges.where("relation = 'depends_on'").collect()}
    assert static == {("r:file:a.py", "r:file:pkg/util.py"), ("r:file:main.go", "r:file:internal/config/config.go"), ("r:file:web/app.ts", "r:file:web/lib/index.ts"), ("r:file:web/app.ts", "r:file:lib/src/main.ts")}
    assert g.edges.where("src = 'project:r'").count() == len(listed)
    projected = {(r.src, r.dst, r.projected_from) for r in G.file_projection(graph(spark, [("fa", "a.go", "file", "a.go"), ("fb", "b.go", "file", "b.go"), ("m", "main", "function", "a.go"), ("l", "Load", "function", "b.go")], [("m", "Load", "calls"), ("m", "l", "uses")])).collect()}
    assert projected == {("fa", "fb", "calls")}


def test_contracts(spark):
    docs = [("api/openapi.json", json.dumps({"openapi": "3.0", "info": {"title": "Billing"}, "paths": {"/b": {"post": {}, "x": {}}, "/a": {"get": {}}}})), ("swagger.yaml", "swagger: '2.0'\npaths:\n  /z:\n    get:\n      summary: x\n"), ("a.proto", "service Auth {\n  rpc Login(R) returns (S);\n}\nservice B {\n rpc C(R) returns (S);\n}\n"), ("plain.yaml", "openapi: 3"), ("openapi.txt", "x")]
    g = contracts.contracts(spark.createDataFrame(docs, "path string, content string"), "project:x")
    ids = {r.id for r in g.nodes.collect()}
    assert ids == {"contract:service:billing", "contract:endpoint:billing:get:/a", "contract:endpoint:billing:post:/b", "contract:service:swagger", "contract:endpoint:swagger:get:/z", "contract:service:auth", "contract:rpc:auth:login", "contract:service:b", "contract:rpc:b:c"}
    assert {r.relation: r.n for r in g.edges.groupBy("relation").agg(F.count("*").alias("n")).collect()} == {"declares": 5, "declared_in": 4}


def test_documents(spark, requests, tmp_path):
    path = str(tmp_path / "graph.json")
    documents.write_json(requests, path)
    back = graph_json.read_graph(spark, path)
    key = ["id", "label", "kind", "file", "source_name", "organization", "community", "layer"]
    assert sorted(map(tuple, back.nodes.select(*key).collect())) == sorted(map(tuple, requests.nodes.select(*key).collect()))
    assert sorted(map(tuple, back.edges.select("src", "dst", "relation").collect())) == sorted(map(tuple, requests.edges.select("src", "dst", "relation").collect()))
    meta = json.loads(open(path).read())["meta"]
    assert (meta["nodeCount"], meta["edgeCount"]) == (4, 4)
    both = graph_json.read_graphs(spark, [path, path])
    assert both.nodes.count() == 4 and both.edges.count() == 4
    text = documents.report(requests.built())
    assert "# The graph: 4 nodes, " in text and "* `AuthService` (struct), 3 neighbours" in text and "not clustered" in text
    assert "AuthService" in documents.page(requests.built())
    assert documents.cypher(requests).where("statement like 'MERGE (n:Struct%'").count() == 3
    assert vault.write_vault(requests, str(tmp_path / "vault")) == 4
    documents.write_manifest(manifest.manifest(spark.createDataFrame([("a.go", "x")], "path string, content string")), str(tmp_path / "m.json"))
    assert graph_json.read_manifest(spark, str(tmp_path / "m.json")).first().language == "go"
    (tmp_path / "r.json").write_text(json.dumps({"entries": [{"repo_root": "/x/shop/", "name": ""}, {"repo_root": " "}]}))
    assert [(r.repo_root, r.name) for r in graph_json.read_registry(spark, str(tmp_path / "r.json")).collect()] == [("/x/shop", "shop")]


def test_debounce(spark, tmp_path):
    e = spark.createDataFrame([("r", "a.go", 0), ("r", "b.go", 200), ("r", "a.go", 400), ("r", "c.go", 1000)], "root string, path string, ms long").select("root", "path", F.timestamp_millis("ms").alias("ts"))
    got = sorted((r.paths, r.events) for r in watch.debounced(e).collect())
    assert got == [(["a.go", "b.go"], 3), (["c.go"], 1)]
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = watch.watch(stream, lambda df, n: seen.extend(r.paths for r in df.collect()), str(tmp_path / "cp"), lateness="0 seconds", availableNow=True)
    q.awaitTermination(120)
    assert ["a.go", "b.go"] in seen


def test_label_propagation_by_numbers(spark, monkeypatch):
    """As a plain loop over every node, also with ends that are no nodes; rounds hold numbers only, not ids."""
    rng = random.Random(4)
    ids = [f"n{k}" for k in range(30)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(70)]
    near = {}
    for a, b in pairs:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {}).setdefault(y, 0)
                near[x][y] += 1
    for known in (ids, ids[:12]):
        labels = {k: k for k in known}
        for _ in range(4):
            votes = {k: {v: 1} for k, v in labels.items()}
            for x, of in near.items():
                for y, w in of.items():
                    if y in labels:
                        own = votes.setdefault(x, {})
                        own[labels[y]] = own.get(labels[y], 0) + w
            new = {k: min(v, key=lambda c, v=v: (-v[c], c)) for k, v in votes.items()}
            same = all(new[k] == v for k, v in labels.items())
            labels = new
            if same:
                break
        rounds, real = [], community.scratch
        monkeypatch.setattr(community, "scratch", lambda df, name: rounds.append((name, df.dtypes)) or real(df, name))
        nodes, edges = spark.createDataFrame([(k,) for k in known], "id string"), spark.createDataFrame(pairs, "src string, dst string")
        got = {r.id: r.label for r in community.label_propagation(nodes, edges, 4).collect()}
        monkeypatch.setattr(community, "scratch", real)
        assert got == labels
        assert {t for name, columns in rounds if name == "labels" for _, t in columns} == {"bigint"}


def test_linked_is_built_without_repeats(spark):
    """Parallel, dangling, unknown and self edges, and targets by label; no column of a winning copy is carried."""
    edges = [("a", "b", "calls", f, c, float(k), k) for k, (f, c) in enumerate([("x.go", "A"), ("x.go", "B"), ("y.go", None)])]
    edges += [("a", "B", "calls", "z.go", None, 0.0, 9), ("a", "a", "calls", "", None, 0.0, 10), ("ghost", "a", "calls", "", None, 0.0, 11), ("b", "missing", "calls", "", None, 0.0, 12), ("b", "a", "uses", "", None, 0.0, 13)]
    nodes = [("a", "A", "f", "", 0), ("b", "B", "f", "", 1), ("b", "again", "f", "", 2), ("c", "B", "f", "", 3), ("", "none", "f", "", 4)]
    g = G.Graph(spark.createDataFrame(nodes, "id string, label string, kind string, file string, ord long"), spark.createDataFrame(edges, "src string, dst string, relation string, file string, confidence string, score double, ord long"))
    got = g.linked()
    assert got.edges.columns == ["src", "dst", "relation"]
    assert sorted(map(tuple, got.edges.collect())) == sorted(map(tuple, g.built().edges.select("src", "dst", "relation").distinct().collect())) == [("a", "b", "calls"), ("b", "a", "uses")]
