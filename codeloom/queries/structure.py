"""Queries of rows Q2-Q16, X25, L1-L8, I1-I14, R4-R20, S8-S18, F1-F10, W1-W6, B1-B8, X21, P1-P6, T1."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import identity as I
from codeloom.functions import text as T
from codeloom.operators import binding as B
from codeloom.operators import graph as G
from codeloom.operators import ignore, lookup, manifest
from codeloom.operators import traverse as V
from codeloom.operators import workspace as W
from codeloom.session import dealt

from .projections import CANON, RAW_SUPPLY, SUPPLY, TRADE, supply, trade


def _read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


# --- traversal


def q2(spark, sf):
    start = spark.createDataFrame([("region:ASIA",)], "id string")
    return V.reachable(trade(spark, sf), start)


def q2_limited(spark, sf):
    return V.dependencies(trade(spark, sf), "nation:NATION_8", 20)


def q3(spark, sf):
    return V.dependencies(trade(spark, sf), "part:7", 20, reverse=True)


def q7(spark, sf):
    return V.impact(trade(spark, sf), "part:7")


def q8(spark, sf):
    return V.shortest_path(trade(spark, sf), "region:EUROPE", "part:11")


def _files(spark, sf):
    """Parts as files under paths that the ranking knows, linked where one line of an order follows another."""
    from pyspark.sql import functions as F

    parts = _read(spark, sf, "part").selectExpr(*_FILE_EXPRS)
    lines = _read(spark, sf, "lineitem")
    keys, rows = ["l_orderkey", "l_linenumber"], lines.count()
    after = lines.selectExpr("l_orderkey", "l_linenumber - 1 AS l_linenumber", "l_partkey AS next_partkey")
    return parts, dealt(lines.select(*keys, "l_partkey", "l_returnflag"), rows, *keys).join(dealt(after, rows, *keys), keys).selectExpr(*_LINK_EXPRS).where(F.expr("src <> dst"))


_FILE_PATH = (
    "CASE p_partkey % 7 WHEN 0 THEN 'cmd/app' || CAST(p_partkey % 5 AS STRING) || '/main.go' WHEN 1 THEN 'internal/auth/service' || CAST(p_partkey AS STRING) || '.go' WHEN 2 THEN 'packages/api/src/index.ts' "
    "WHEN 3 THEN 'packages/ui' || CAST(p_partkey % 3 AS STRING) || '/components/page' || CAST(p_partkey AS STRING) || '.tsx' WHEN 4 THEN 'internal/config/config.go' "
    "WHEN 5 THEN 'apps/mobile/domain/hook' || CAST(p_partkey AS STRING) || '.test.ts' ELSE 'pkg/types/types.go' END"
)
_FILE_EXPRS = ["'f' || CAST(p_partkey AS STRING) AS id", f"{_FILE_PATH} || '' AS label", "'file' AS kind", f"{_FILE_PATH} AS file"]
_LINK_EXPRS = [
    "'f' || CAST(l_partkey AS STRING) AS src", "'f' || CAST(next_partkey AS STRING) AS dst", "CASE WHEN l_linenumber = 3 THEN 'calls' ELSE 'depends_on' END AS relation",
    "CASE WHEN l_returnflag = 'N' THEN 'static_import' ELSE 'calls' END AS projected_from", "l_orderkey * 10 + l_linenumber AS ord",
]


def q4(spark, sf):
    nodes, edges = _files(spark, sf)
    return V.file_dependencies(nodes, edges, nodes.select(F.col("id").alias("subject")), 5)


def q4_reverse(spark, sf):
    nodes, edges = _files(spark, sf)
    return V.file_dependencies(nodes, edges, nodes.select(F.col("id").alias("subject")), 5, reverse=True)


def q5(spark, sf):
    nodes, _ = _files(spark, sf)
    return nodes.select("id", V.file_score(F.col("file"), F.lit(True)).alias("score"), V.barrel_root(F.col("file")).alias("barrel"), V.path_root(F.col("file")).alias("root"))


def q14(spark, sf):
    """Explain: edges at any node that the reference means."""
    g = supply(spark, sf)
    ids = G.resolve_all(g.nodes, spark.createDataFrame([("NATION_12", "")], "ref string, layer string"))
    hit = g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").unionByName(g.edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return hit.select("src", "relation", "dst", I.evidence_confidence(F.lit(""), F.col("confidence")).alias("confidence")).distinct()


def x25(spark, sf):
    return G.file_projection(_projected(spark, sf))


def _projected(spark, sf):
    g = supply(spark, sf)
    files = g.nodes.where("kind = 'function'").select(F.concat(F.lit("catalog:file:"), "file").alias("id"), F.col("file").alias("label"), F.lit("file").alias("kind"), "file", F.min("ord").over(__import__("pyspark").sql.Window.partitionBy("file")).alias("ord")).distinct()
    n = g.nodes.select("id", "label", "kind", "file", "ord").unionByName(files)
    return G.Graph(n, g.edges)


# --- lookup and identity


def l1(spark, sf):
    return lookup.lookup(supply(spark, sf).nodes, "ring suppliers/nation_3", 20)


def l1_path(spark, sf):
    return lookup.lookup(supply(spark, sf).nodes, "packages/brand11/src", 20)


def l6(spark, sf):
    return lookup.search(supply(spark, sf).nodes, "nation_3", 20)


def l3(spark, sf):
    return _read(spark, sf, "pages").select("page_id", F.array_join(T.lookup_tokens(F.col("url")), " ").alias("tokens"), T.path_suffix(F.col("url")).alias("suffix"))


_REFS = [("ASIA", ""), ("asia", ""), ("project:EUROPE", ""), ("repo:repo:AFRICA", ""), ("small ring", "repo"), ("nothing here", ""), ("catalog:part:3", "contract")]


def i7(spark, sf):
    refs = spark.createDataFrame(_REFS, "ref string, layer string").unionByName(supply(spark, sf).nodes.where("kind = 'function'").select(F.col("label").alias("ref"), F.lit("").alias("layer")).distinct())
    return G.resolve_one(supply(spark, sf).nodes, refs.distinct())


_ID_EXPR = (
    "CASE user_id % 12 WHEN 0 THEN 'memory:observation:' || CAST(event_id AS STRING) WHEN 1 THEN 'repo:function:' || event_type WHEN 2 THEN 'memory:concept:' || event_type WHEN 3 THEN 'workspace:repo:' || event_type "
    "WHEN 4 THEN 'contract:rpc:a:' || event_type WHEN 5 THEN 'project:' || event_type WHEN 6 THEN 'web:file:src/' || event_type || '.ts' WHEN 7 THEN ' plain' || CAST(event_id AS STRING) || ' ' WHEN 8 THEN '' "
    f"WHEN 9 THEN '{I.OBSERVATION}' || CAST(event_id AS STRING) WHEN 10 THEN 'other:x:y' ELSE 'repo::bad' END"
)


def i2(spark, sf):
    e = _read(spark, sf, "events").selectExpr("event_id", f"{_ID_EXPR} AS id", "CASE WHEN event_id % 3 = 0 THEN 'struct' ELSE '' END AS kind", "CASE WHEN event_id % 5 = 0 THEN 'shop' ELSE '' END AS source_name")
    k = I.canonical_key_for_id(F.col("id"), F.col("kind"), F.col("source_name"))
    p = I.parse_canonical_key(F.col("id"))
    return e.select("event_id", k["layer"].alias("layer"), k["kind"].alias("key_kind"), k["key"].alias("key"), I.canonical_join_key(F.col("id"), F.col("kind"), F.col("source_name")).alias("join_key"), p["kind"].alias("parsed_kind"))


def i11(spark, sf):
    r = I.remote_identity(F.col("url"))
    return _read(spark, sf, "pages").select("page_id", r["id"].alias("id"), r["organization"].alias("organization"), r["name"].alias("name"))


def i13(spark, sf):
    p = _read(spark, sf, "part")
    repo, path, name = F.lit("shop"), F.col("p_type"), F.col("p_name")
    return p.select("p_partkey", I.file_node_id(repo, path).alias("file_id"), I.symbol_node_id(repo, path, name).alias("symbol_id"), I.workspace_node_id("package", F.col("p_brand")).alias("package_id"), I.label_of_id(I.symbol_node_id(repo, path, name)).alias("label"))


def r8(spark, sf):
    conf = F.when(F.col("l_returnflag") == "A", "declared").when(F.col("l_returnflag") == "R", "inferred").otherwise("")
    legacy = F.when(F.col("l_linestatus") == "O", "EXTRACTED").otherwise("AMBIGUOUS")
    ver = F.element_at(F.array(*map(F.lit, ("current", "redirected", "ambiguous", "stale", ""))), F.col("l_linenumber") % 5 + 1)
    w = I.evidence_weight(I.evidence_confidence(conf, legacy), ver, F.col("l_discount"))
    return _read(spark, sf, "lineitem").groupBy(F.round(w, 6).alias("weight")).agg(F.count("*").alias("n"))


# --- merging


def _facts(spark, sf):
    e = _read(spark, sf, "lineitem")
    prov = lambda s, d, c, a: F.struct(F.lit(s).alias("source"), F.lit(d).alias("driver"), F.lit(c).alias("confidence"), F.lit(a).alias("artifact"))
    one, two = prov("scip", "go", "declared", " index.scip "), prov("", "ts", "", "")
    lists = F.when(F.col("l_returnflag") == "A", F.array(two, one)).when(F.col("l_returnflag") == "R", F.array(one, two)).otherwise(F.array().cast("array<struct<source:string,driver:string,confidence:string,artifact:string>>"))
    return e.select(
        F.concat(F.lit("catalog:part:"), F.col("l_partkey").cast("string")).alias("from_id"),
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("fresh:sym/"), F.col("l_suppkey").cast("string"))).otherwise("").alias("to_id"),
        F.lit("calls").alias("kind"), lists.alias("provenance"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    ).groupBy("from_id", "to_id", "kind", "ord").agg(F.first("provenance").alias("provenance"))


def r4(spark, sf):
    merged = G.merge_facts(supply(spark, sf), _facts(spark, sf).groupBy("from_id", "to_id", "kind").agg(F.min("ord").alias("ord"), F.min_by("provenance", F.struct("ord", F.to_json("provenance"))).alias("provenance")))
    none = [F.lit(None).cast("string").alias(c) for c in ("evidence_type", "evidence_confidence", "evidence_artifact")]
    nodes = merged.nodes.select(F.lit("node").alias("what"), "id", "label", "kind", *none)
    return nodes.unionByName(merged.edges.select(F.lit("edge").alias("what"), F.col("src").alias("id"), F.col("dst").alias("label"), F.col("relation").alias("kind"), "evidence_type", "evidence_confidence", "evidence_artifact"))


def r6(spark, sf):
    g = supply(spark, sf)
    declared = g.edges.where("relation = 'supplies' and ord % 3 = 0").withColumns({"confidence": F.lit("DECLARED"), "ord": F.col("ord") + 1})
    merged = G.merge_contract(g, G.Graph(g.nodes.where("kind = 'project'").withColumn("label", F.lit("contract")), declared))
    return merged.edges.select("src", "dst", "relation", "confidence", F.round("score", 6).alias("score"))


def r20(spark, sf):
    e = _read(spark, sf, "events")
    return e.select("event_id", I.stable_fact_key(F.lit(" shop "), F.upper("event_type"), F.lit("calls"), F.col("user_id").cast("string"), F.lit(None).cast("string")).alias("key"))


# --- manifests


def _contents(spark, sf):
    return _read(spark, sf, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")


def _manifests(spark, sf):
    """Two versions of a repository, so that there is something new, changed and deleted."""
    d = _contents(spark, sf)
    saved = manifest.manifest(d.where("doc_id % 10 <> 2"))
    current = manifest.manifest(d.where("doc_id % 10 <> 0").withColumn("content", F.when(F.col("doc_id") % 10 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content"))))
    return saved, current


def s9(spark, sf):
    return manifest.manifest(_contents(spark, sf))


def r10(spark, sf):
    return manifest.diff(*_manifests(spark, sf))


def r11(spark, sf):
    return manifest.reuse_mode(r10(spark, sf))


def r13(spark, sf):
    g = supply(spark, sf)
    gone = g.nodes.where("kind = 'file' and ord % 4 = 0").select(F.concat(F.lit("./"), "file").alias("path"))
    p = G.pruned(g, gone)
    n = p.nodes.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n"))
    return n.unionByName(p.edges.groupBy(F.concat(F.lit("edge "), "relation").alias("what")).agg(F.count("*").alias("n")))


def r17(spark, sf):
    c = _read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 7 = 0").withColumns({"c_name": F.lit("renamed"), "c_custkey": F.col("c_custkey") + 1})
    return manifest.removed(manifest.upsert(c, new, ["c_custkey"]), c.where("c_custkey % 11 = 0"), ["c_custkey"])


def s18(spark, sf):
    s = ["package.json", "go.mod", "Cargo.toml", "pom.xml", "setup.py", "notes.md", "requirements.txt"]
    files = _read(spark, sf, "orders").select(F.concat(F.lit("repo"), (F.col("o_custkey") % 300).cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, s)), (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("path"))
    return ignore.detect_stack(files.where("length(path) > 0").distinct())


# --- functions


def f1(spark, sf):
    d = _read(spark, sf, "documents")
    name = F.coalesce("text", F.lit(""))
    return d.select("doc_id", T.safe_file_name(name).alias("file_name"), T.slug(name).alias("slug"), T.tag(F.col("source")).alias("tag"), T.export_label(F.col("lang")).alias("label"), T.export_relation(F.lit("calls")).alias("relation"), T.language_of(F.concat(F.lit("x/y."), "lang")).alias("language"), T.is_code_file(F.lit("a/B.TSX")).alias("code"))


def b5(spark, sf):
    p = _read(spark, sf, "pages")
    return p.select("page_id", T.shared_suffix(F.col("url"), F.concat(F.lit("x/"), F.upper(T.path_suffix(F.col("url"))))).alias("score"), T.shared_suffix(F.col("url"), F.lit("a/b")).alias("none"))


def w4(spark, sf):
    return W.select_repos(_terms(spark, sf), ["an", "nation_1", "brand#1"], 10).select("repo", "score")


def _terms(spark, sf):
    """Nations as repositories, their suppliers as services, market segments as domains, brands as packages."""
    n = _read(spark, sf, "nation")
    named = n.select(F.lower("n_name").alias("repo_key"), F.col("n_name").alias("repo"), F.lit("name").alias("term_kind"), F.col("n_name").alias("term"))
    s = _read(spark, sf, "supplier").join(n, F.expr("s_nationkey = n_nationkey")).select(F.lower("n_name").alias("repo_key"), F.col("n_name").alias("repo"), F.lit("service").alias("term_kind"), F.col("s_name").alias("term"))
    d = _read(spark, sf, "customer").join(n, F.expr("c_nationkey = n_nationkey")).select(F.lower("n_name").alias("repo_key"), F.col("n_name").alias("repo"), F.lit("domain").alias("term_kind"), F.col("c_mktsegment").alias("term")).distinct()
    p = _read(spark, sf, "part").select("p_brand", (F.col("p_partkey") % 25).alias("k")).join(n, F.expr("k = n_nationkey")).select(F.lower("n_name").alias("repo_key"), F.col("n_name").alias("repo"), F.lit("package").alias("term_kind"), F.col("p_brand").alias("term")).distinct()
    return named.unionByName(s).unionByName(d).unionByName(p)


def w2(spark, sf):
    nodes, edges = W.materialized(_terms(spark, sf))
    a = nodes.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.col("relation").alias("what")).agg(F.count("*").alias("n")))


_TARGET_EXPR = (
    "CASE s_suppkey % 5 WHEN 0 THEN 'repo:file:suppliers/' || lower(replace(n_name, ' ', '_')) || '/' || s_name || '.go' WHEN 1 THEN 'repo:file:old/place/' || upper(s_name) || '.go' WHEN 2 THEN 'repo:symbol:' || upper(n_name) "
    "WHEN 3 THEN 'workspace:repo:' || lower(r_name) ELSE 'concept:' || s_name END"
)


def b2(spark, sf):
    g = supply(spark, sf)
    s = _read(spark, sf, "supplier").join(_read(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey")).join(_read(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    return B.bindings(s.selectExpr(f"{_TARGET_EXPR} AS target"), g.nodes).select("target", "state", "bound_target", "evidence")


_NOTE = "'see src/' || source || '/' || lang || '.md and #' || CAST(doc_id AS STRING) || ', obs:12 or `Auth.Service` in [[Topic ' || lang || ']]'"


def x21(spark, sf):
    d = _read(spark, sf, "documents").selectExpr("doc_id", f"{_NOTE} AS note")
    return d.select("doc_id", F.explode(B.references(F.lit("Title `Other`"), F.col("note"))).alias("r")).select("doc_id", "r.kind", "r.target")


def p1(spark, sf):
    paths = _read(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    own = ignore.rules(["*.html", "!4*.html", "/www.*/en/", "blog.**", "# note", "es/"])
    return paths.select("page_id", ignore.ignored_with_parents(F.col("path"), [own]).alias("ignored"))


def t1(spark, sf):
    from codeloom.streaming.watch import debounced

    e = _read(spark, sf, "events").select(F.col("user_id").cast("string").alias("root"), F.concat(F.col("event_type"), F.lit(".go")).alias("path"), "ts")
    return debounced(e, "6 hours").select("root", F.size("paths").alias("n_paths"), "events", "first_at")


QUERIES = {
    "Q2_reachable": q2, "Q2_dependencies": q2_limited, "Q3_reverse_dependencies": q3, "Q7_impact": q7, "Q8_shortest_path": q8, "Q4_file_dependencies": q4, "Q4_Q6_file_callers": q4_reverse,
    "Q5_Q12_file_scores": q5, "Q14_explain": q14, "X25_file_projection": x25, "L1_lookup": l1, "L1_lookup_path": l1_path, "L6_search": l6, "L3_L4_tokens": l3, "I7_R15_resolve": i7,
    "I1_I2_canonical_keys": i2, "I11_remote_identity": i11, "I13_ids": i13, "R8_R9_evidence_weight": r8, "R4_R5_merge_facts": r4, "R6_R7_merge_contract": r6, "R20_fact_keys": r20,
    "S9_S10_manifest": s9, "R10_manifest_diff": r10, "R11_reuse_mode": r11, "R13_R14_prune": r13, "R17_upsert": r17, "S18_stacks": s18, "F1_F10_names": f1, "B5_shared_suffix": b5,
    "W4_select_repos": w4, "W2_materialize": w2, "B2_B4_bindings": b2, "X21_references": x21, "P1_P4_ignored": p1, "T1_debounce": t1,
}

_F = f"files AS (SELECT {', '.join(_FILE_EXPRS)} FROM part), links AS (SELECT * FROM (SELECT {', '.join(_LINK_EXPRS)} FROM lineitem JOIN (SELECT l_orderkey, l_linenumber - 1 AS l_linenumber, l_partkey AS next_partkey FROM lineitem) USING (l_orderkey, l_linenumber)) WHERE src <> dst)"


def _file_score(p: str, static: str) -> str:
    each = [(t, 20) for t in ("context", "hook", "service", "domain", "reader", "main.go", "server.go")] + [(t, -15) for t in ("/domain/", "/kitchen/", "/dashboard/")]
    each += [(t, -25) for t in ("_test.go", ".spec.", ".test.", "/components/", "/page.tsx", "/index.tsx")]
    starts = [("cmd/", 50), ("apps/mobile/", 15), ("apps/desktop-pos/", 10), ("apps/web-portal/", -5)]
    parts = [f"CASE WHEN {static} THEN 100 ELSE 0 END"] + [f"CASE WHEN contains({p}, '{t}') THEN {n} ELSE 0 END" for t, n in each] + [f"CASE WHEN starts_with({p}, '{t}') THEN {n} ELSE 0 END" for t, n in starts]
    parts += [f"CASE WHEN contains({p}, '/server/') OR contains({p}, '/auth/') THEN 40 ELSE 0 END", f"CASE WHEN contains({p}, '/presentation/') OR contains({p}, '/shared/contexts/') THEN 35 ELSE 0 END"]
    return "(" + " + ".join(parts) + ")"


def _q4(reverse: bool) -> str:
    s, d = ("dst", "src") if reverse else ("src", "dst")
    outside = "b.root <> '' AND NOT starts_with(lower(f.file), b.root)" if reverse else "false"
    return f"""WITH {_F},
    first AS (SELECT {s} AS s, {d} AS d, arg_min(struct_pack(r := relation, p := projected_from), struct_pack(o := ord, r := relation, p := projected_from)) AS x FROM links WHERE {s} IN (SELECT id FROM files) GROUP BY 1, 2),
    barrels AS (SELECT id, CASE WHEN regexp_matches(lower(file), '^packages/.+/src/index\\.(ts|tsx|js|jsx)$') THEN regexp_extract(lower(file), '^(packages/.+)/src/index\\.', 1) || '/' ELSE '' END AS root FROM files),
    c AS (SELECT s, d, f.label, x.r AS relation, x.p IN ('static_import', 'workspace_package') AS static, lower(f.file) AS p, {outside} AS outside FROM first JOIN files f ON d = f.id JOIN barrels b ON s = b.id),
    c1 AS (SELECT * FROM c QUALIFY static OR NOT bool_or(static) OVER (PARTITION BY s)),
    c2 AS (SELECT *, contains(p, '_test.go') OR contains(p, '.test.') OR contains(p, '.spec.') OR contains(p, 'bench') AS test FROM c1),
    c3 AS (SELECT * FROM c2 QUALIFY NOT test OR count(*) FILTER (NOT test) OVER (PARTITION BY s) < 2),
    c4 AS (SELECT * FROM c3 QUALIFY outside OR count(*) FILTER (outside) OVER (PARTITION BY s) < 2),
    sc AS (SELECT *, {_file_score('p', 'static')} AS score FROM c4)
    SELECT s AS subject, row_number() OVER (PARTITION BY s ORDER BY score DESC, label, d, relation)::INT AS position, d AS id, relation, score::INT AS score FROM sc QUALIFY position <= 5"""


_REACH = "walk AS (SELECT '{start}' AS id, 0 AS hops UNION SELECT {to}, hops + 1 FROM walk JOIN edges ON {at} = walk.id WHERE hops < 9)"
_ID = "trim(id)"
_PREFIXES = " ".join(f"WHEN starts_with({_ID}, '{p}') THEN struct_pack(layer := '{layer}', kind := '{k}', key := substr({_ID}, {len(p) + 1}))" for p, layer, k in I.ID_PREFIXES)
_KEY_SQL = rf"""CASE WHEN {_ID} = '' THEN NULL WHEN starts_with({_ID}, 'memory:observation:') THEN struct_pack(layer := 'memory', kind := 'observation', key := '{I.OBSERVATION}' || substr({_ID}, 20))
    WHEN regexp_matches({_ID}, '^(repo|contract|workspace|memory):[^:]+:.+$') THEN struct_pack(layer := split_part({_ID}, ':', 1), kind := split_part({_ID}, ':', 2), key := regexp_extract({_ID}, '^[^:]+:[^:]+:(.+)$', 1))
    WHEN starts_with({_ID}, '{I.OBSERVATION}') THEN struct_pack(layer := 'memory', kind := 'observation', key := {_ID}) {_PREFIXES}
    WHEN instr({_ID}, ':file:') > 1 THEN struct_pack(layer := 'repo', kind := 'file', key := substr({_ID}, 1, instr({_ID}, ':file:') - 1) || '/' || substr({_ID}, instr({_ID}, ':file:') + 6))
    WHEN source_name <> '' THEN struct_pack(layer := 'repo', kind := CASE WHEN trim(kind) = '' THEN 'node' ELSE trim(kind) END, key := source_name || '/' || {_ID})
    WHEN kind <> '' THEN struct_pack(layer := 'repo', kind := kind, key := {_ID}) END"""


def _lookup_sql(term: str, limit: int) -> str:
    import re

    tokens = list(dict.fromkeys(re.findall(r"[\w/.-]+", term)))
    suffix = "/".join(term.split("/")[-2:])
    each = [f"(CASE WHEN contains(l, '{t}') THEN 18 WHEN contains(f, '{t}') THEN 16 WHEN contains(i, '{t}') THEN 14 WHEN contains(d, '{t}') THEN 6 ELSE 0 END)" for t in tokens]
    matched = " + ".join(f"({e} > 0)::INT" for e in each)
    path_like = "/" in term or "." in term
    return f"""WITH {SUPPLY}, n AS (SELECT id, label, kind, lower(trim(label)) AS l, lower(trim(id)) AS i, lower(trim(file)) AS f, lower(trim(description)) AS d FROM nodes),
    s AS (SELECT id, label, kind, CASE WHEN ({matched}) = 0 THEN 0 ELSE CASE WHEN l = '{term}' OR i = '{term}' THEN 100 WHEN f = '{term}' THEN 95 WHEN array_to_string(list_slice(string_split(f, '/'), -2, -1), '/') = '{suffix}' THEN 85
        WHEN contains(l, '{term}') THEN 70 WHEN contains(f, '{term}') THEN 65 WHEN contains(i, '{term}') THEN 60 ELSE 0 END + {' + '.join(each)} + CASE WHEN ({matched}) = {len(tokens)} AND {len(tokens)} > 1 THEN 20 ELSE 0 END
        + CASE WHEN kind = 'file' THEN {12 if path_like else 0} ELSE {0 if path_like else 8} END + CASE WHEN contains(f, '/test') OR contains(f, '.test.') OR contains(f, '_test.') THEN -10 ELSE 0 END END AS score FROM n)
    SELECT id, label, kind, score::INT AS score FROM s WHERE score <> 0 ORDER BY score DESC, label, id LIMIT {limit}"""


_DOCS = "SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang AS path, coalesce(text, '') AS content, doc_id FROM documents"
_LANGUAGE = "CASE e WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' ELSE e END"
_DIFF = f"""d AS ({_DOCS}), s AS (SELECT path, sha256(content) AS h FROM d WHERE doc_id % 10 <> 2), c AS (SELECT path, sha256(content || CASE WHEN doc_id % 10 = 1 THEN '!' ELSE '' END) AS h FROM d WHERE doc_id % 10 <> 0),
    x AS (SELECT coalesce(s.path, c.path) AS path, CASE WHEN s.h IS NULL THEN 'new' WHEN c.h IS NULL THEN 'deleted' WHEN s.h = c.h THEN 'unchanged' ELSE 'changed' END AS status FROM s FULL JOIN c ON s.path = c.path)"""

_WEIGHT = """CASE conf WHEN 'declared' THEN 4.0 WHEN 'extracted' THEN 3.0 WHEN 'inferred' THEN 2.0 WHEN 'ambiguous' THEN 1.0 ELSE 0 END
    + CASE ver WHEN 'current' THEN 0.30 WHEN 'redirected' THEN 0.15 WHEN 'ambiguous' THEN -0.20 WHEN 'stale' THEN -0.50 ELSE 0 END + CASE WHEN score > 0 THEN score / 100.0 ELSE 0 END"""

_TERMS = """terms AS (SELECT lower(n_name) AS repo_key, n_name AS repo, 'name' AS term_kind, n_name AS term FROM nation
    UNION ALL SELECT lower(n_name), n_name, 'service', s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT DISTINCT lower(n_name), n_name, 'domain', c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT DISTINCT lower(n_name), n_name, 'package', p_brand FROM part JOIN nation ON p_partkey % 25 = n_nationkey)"""

SQL = {
    "Q2_reachable": f"WITH RECURSIVE {TRADE}, {_REACH.format(start='region:ASIA', to='dst', at='src')} SELECT id, min(hops) AS hops FROM walk GROUP BY id",
    "Q7_impact": f"WITH RECURSIVE {TRADE}, {_REACH.format(start='part:7', to='src', at='dst')} SELECT id, min(hops) AS hops FROM walk WHERE id <> 'part:7' GROUP BY id",
    "Q8_shortest_path": f"""WITH RECURSIVE {TRADE}, walk AS (SELECT 'region:EUROPE' AS id, ['region:EUROPE'] AS p UNION SELECT dst, list_append(p, dst) FROM walk JOIN edges ON src = walk.id WHERE len(p) < 5 AND relation <> 'based_in'),
        b AS (SELECT p FROM walk WHERE id = 'part:11' ORDER BY len(p), p LIMIT 1) SELECT unnest(range(0, len(p)))::INT AS hop, unnest(p) AS id FROM b""",
    "Q3_reverse_dependencies": f"""WITH {TRADE}, first AS (SELECT src AS id, min(ord) AS o FROM edges WHERE dst = 'part:7' GROUP BY src), l1 AS (SELECT id, row_number() OVER (ORDER BY o, id) AS k FROM first),
        second AS (SELECT src AS id, min(struct_pack(k := k, o := ord)) AS o FROM edges JOIN l1 ON dst = l1.id GROUP BY src),
        seen AS (SELECT 1 AS lev, k, id, 'includes' AS relation FROM l1 UNION ALL SELECT 2, row_number() OVER (ORDER BY o, id), id, 'places' FROM second)
        SELECT row_number() OVER (ORDER BY lev, k)::INT AS position, id, relation FROM seen ORDER BY lev, k LIMIT 20""",
    "Q2_dependencies": f"""WITH {TRADE} SELECT row_number() OVER (ORDER BY min(ord), dst)::INT AS position, dst AS id, arg_min(relation, ord) AS relation FROM edges WHERE src = 'nation:NATION_8' GROUP BY dst ORDER BY min(ord), dst LIMIT 20""",
    "Q4_file_dependencies": _q4(False),
    "Q4_Q6_file_callers": _q4(True),
    "Q5_Q12_file_scores": f"""WITH {_F}, p AS (SELECT id, lower(trim(file)) AS p FROM files) SELECT id, {_file_score('p', 'true')}::INT AS score,
        CASE WHEN regexp_matches(p, '^packages/.+/src/index\\.(ts|tsx|js|jsx)$') THEN regexp_extract(p, '^(packages/.+)/src/index\\.', 1) || '/' ELSE '' END AS barrel,
        CASE WHEN starts_with(p, 'packages/') AND len(string_split(p, '/')) >= 3 THEN array_to_string(string_split(p, '/')[1:3], '/') || '/' WHEN starts_with(p, 'internal/') OR starts_with(p, 'cmd/') THEN array_to_string(string_split(p, '/')[1:2], '/') || '/'
        ELSE regexp_extract(p, '^(.*/)[^/]*$', 1) END AS root FROM p""",
    "Q14_explain": f"WITH {SUPPLY}, n AS (SELECT id FROM nodes WHERE label = 'NATION_12') SELECT DISTINCT src, relation, dst, lower(coalesce(confidence, '')) AS confidence FROM edges WHERE src IN (SELECT id FROM n) OR dst IN (SELECT id FROM n)",
    "X25_file_projection": f"""WITH {SUPPLY}, n AS (SELECT id, label, kind, file, ord FROM nodes UNION ALL SELECT 'catalog:file:' || file, file, 'file', file, min(ord) FROM nodes WHERE kind = 'function' GROUP BY file),
        lab AS (SELECT label, arg_min(id, struct_pack(o := ord, i := id)) AS label_id FROM n WHERE label <> '' GROUP BY label), fl AS (SELECT label, arg_min(id, struct_pack(o := ord, i := id)) AS file_id FROM n WHERE kind = 'file' GROUP BY label),
        own AS (SELECT id, CASE WHEN kind = 'file' THEN id ELSE file_id END AS owner FROM n LEFT JOIN fl ON n.file = fl.label),
        e AS (SELECT src, coalesce(i.id, lab.label_id) AS dst, relation, e.ord FROM edges e LEFT JOIN n i ON e.dst = i.id LEFT JOIN lab ON e.dst = lab.label WHERE relation <> 'contains')
        SELECT a.owner AS src, b.owner AS dst, 'depends_on' AS relation, arg_min(relation, e.ord) AS projected_from, min(e.ord) AS ord FROM e JOIN own a ON e.src = a.id JOIN own b ON e.dst = b.id WHERE a.owner <> b.owner GROUP BY a.owner, b.owner""",
    "L1_lookup": _lookup_sql("ring suppliers/nation_3", 20),
    "L1_lookup_path": _lookup_sql("packages/brand11/src", 20),
    "L6_search": f"""WITH {SUPPLY}, s AS (SELECT id, label, kind, CASE WHEN lower(label) = 'nation_3' OR lower(id) = 'nation_3' THEN 10 WHEN contains(lower(label), 'nation_3') THEN 6 WHEN contains(lower(id), 'nation_3') THEN 5 ELSE 0 END
        + CASE WHEN contains(lower(file), 'nation_3') THEN 3 ELSE 0 END + CASE WHEN contains(lower(description), 'nation_3') THEN 2 ELSE 0 END AS score FROM nodes) SELECT id, label, kind, score::INT AS score FROM s WHERE score <> 0 ORDER BY score DESC, label, id LIMIT 20""",
    "L3_L4_tokens": r"""SELECT page_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS tokens, array_to_string(list_slice(string_split(trim(url), '/'), -2, -1), '/') AS suffix
        FROM (SELECT page_id, url, regexp_extract_all(url, '[\p{L}\p{N}/._-]+') AS t FROM pages)""",
    "I7_R15_resolve": f"""WITH {SUPPLY}, refs AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _REFS)}) t(ref, layer) UNION SELECT DISTINCT label, '' FROM nodes WHERE kind = 'function'),
        n AS (SELECT *, {_KEY_SQL} AS k FROM nodes), c AS (SELECT *, coalesce(k.layer || ':' || k.kind || ':' || k.key, trim(id)) AS canonical FROM n),
        r AS (SELECT ref, layer AS asked, trim(ref) AS t FROM refs), rr AS (SELECT ref, asked, t, coalesce(k.layer || ':' || k.kind || ':' || k.key, t) AS rc FROM (SELECT ref, asked, t, {_KEY_SQL.replace(_ID, 't').replace('source_name', "''").replace('kind)', "'')").replace('kind <>', "'' <>").replace('kind := kind', "kind := ''")} AS k FROM r)),
        m AS (SELECT ref, id, 1 AS tier, asked, layer, ord FROM rr JOIN c ON t = id UNION ALL SELECT ref, id, 2, asked, layer, ord FROM rr JOIN c ON rc = canonical UNION ALL SELECT ref, id, 3, asked, layer, ord FROM rr JOIN c ON t = label
            UNION ALL SELECT ref, id, 4, asked, layer, ord FROM rr JOIN c ON lower(t) = lower(label))
        SELECT ref, id, tier FROM m QUALIFY row_number() OVER (PARTITION BY ref ORDER BY tier, CASE WHEN asked = layer THEN 0 ELSE 1 END, ord, id) = 1""",
    "I1_I2_canonical_keys": f"""WITH e AS (SELECT event_id, {_ID_EXPR} AS id, CASE WHEN event_id % 3 = 0 THEN 'struct' ELSE '' END AS kind, CASE WHEN event_id % 5 = 0 THEN 'shop' ELSE '' END AS source_name FROM events), kk AS (SELECT *, {_KEY_SQL} AS k FROM e)
        SELECT event_id, kk.k.layer AS layer, kk.k.kind AS key_kind, kk.k.key AS key, coalesce(kk.k.layer || ':' || kk.k.kind || ':' || kk.k.key, trim(id)) AS join_key, CASE WHEN regexp_matches(trim(id), '^(repo|contract|workspace|memory):[^:]+:.+$') THEN split_part(trim(id), ':', 2) END AS parsed_kind FROM kk""",
    "I11_remote_identity": r"""WITH p AS (SELECT page_id, regexp_replace(trim(url), '\.git$', '') AS t FROM pages), q AS (SELECT page_id, regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/?#:]+)(?::[0-9]+)?/', 1) AS host,
        regexp_replace(regexp_replace(regexp_extract(t, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?[^/?#:]+(?::[0-9]+)?/([^?#]*)', 1), '/+', '/', 'g'), '^/|/$', '', 'g') AS path FROM p)
        SELECT page_id, host || CASE WHEN path = '' THEN '/' ELSE '/' || path END AS id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS organization, regexp_extract(path, '([^/]*)$', 1) AS name FROM q""",
    "I13_ids": "SELECT p_partkey, 'shop:file:' || p_type AS file_id, 'shop:' || p_type || ':' || p_name AS symbol_id, 'workspace:package:' || lower(p_brand) AS package_id, p_name AS label FROM part",
    "R8_R9_evidence_weight": f"""WITH x AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'declared' WHEN l_returnflag = 'R' THEN 'inferred' WHEN l_linestatus = 'O' THEN 'extracted' ELSE 'ambiguous' END AS conf,
        list_extract(['current', 'redirected', 'ambiguous', 'stale', ''], l_linenumber % 5 + 1) AS ver, l_discount AS score FROM lineitem) SELECT round(CAST({_WEIGHT} AS DOUBLE), 6) AS weight, count(*) AS n FROM x GROUP BY 1""",
    "R4_R5_merge_facts": f"""WITH {SUPPLY}, f AS (SELECT 'catalog:part:' || CAST(l_partkey AS VARCHAR) AS s, 'fresh:sym/' || CAST(l_suppkey AS VARCHAR) AS t, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS r FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2)
        SELECT 'node' AS what, id, label, kind, NULL::VARCHAR AS evidence_type, NULL::VARCHAR AS evidence_confidence, NULL::VARCHAR AS evidence_artifact FROM nodes
        UNION ALL SELECT DISTINCT 'node', t, regexp_extract(t, '([^:]+)$', 1), 'symbol', NULL, NULL, NULL FROM f UNION ALL SELECT 'edge', src, dst, relation, NULL, NULL, NULL FROM edges
        UNION ALL SELECT 'edge', s, t, 'calls', CASE r WHEN 'A' THEN 'scip' WHEN 'R' THEN 'ts' ELSE 'semantic' END, CASE r WHEN 'A' THEN 'declared' ELSE 'extracted' END, CASE r WHEN 'A' THEN 'index.scip' ELSE '' END FROM f""",
    "R6_R7_merge_contract": f"""WITH {SUPPLY}, u AS (SELECT src, dst, relation, 'DECLARED' AS confidence, score, 0 AS part, ord + 1 AS ord FROM edges WHERE relation = 'supplies' AND ord % 3 = 0 UNION ALL SELECT src, dst, relation, confidence, score, 1, ord FROM edges),
        w AS (SELECT *, CASE lower(coalesce(confidence, '')) WHEN 'declared' THEN 4.0 WHEN 'extracted' THEN 3.0 WHEN 'inferred' THEN 2.0 ELSE 0 END::DOUBLE + CASE WHEN score > 0 THEN score / 100.0 ELSE 0 END AS w FROM u)
        SELECT src, dst, relation, confidence, round(score, 6) AS score FROM w QUALIFY row_number() OVER (PARTITION BY src, dst, relation ORDER BY w DESC, score DESC, part, ord, confidence) = 1""",
    "R20_fact_keys": "SELECT event_id, 'shop|' || lower(event_type) || '|calls|' || CAST(user_id AS VARCHAR) || '|' AS key FROM events",
    "S9_S10_manifest": f"WITH d AS ({_DOCS}), x AS (SELECT *, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS e FROM d) SELECT path, sha256(content) AS sha256, octet_length(encode(content))::BIGINT AS size, {_LANGUAGE} AS language, 'active' AS status FROM x",
    "R10_manifest_diff": f"WITH {_DIFF} SELECT path, status FROM x",
    "R11_reuse_mode": f"""WITH {_DIFF} SELECT CASE WHEN count(*) FILTER (status IN ('new', 'changed')) > 0 THEN 'none' WHEN count(*) FILTER (status = 'deleted') > 0 THEN 'deleted_only' ELSE 'unchanged' END AS mode, count(*) FILTER (status = 'new') AS n_new,
        count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) FILTER (status = 'deleted') AS n_deleted FROM x""",
    "R13_R14_prune": f"""WITH {SUPPLY}, gone AS (SELECT file AS path FROM nodes WHERE kind = 'file' AND ord % 4 = 0), rm AS (SELECT id FROM nodes WHERE file IN (SELECT path FROM gone) OR kind = 'file' AND (label IN (SELECT path FROM gone) OR regexp_extract(id, ':file:(.*)$', 1) IN (SELECT path FROM gone)))
        SELECT kind AS what, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM rm) GROUP BY kind UNION ALL SELECT 'edge ' || relation, count(*) FROM edges WHERE file NOT IN (SELECT path FROM gone) AND src NOT IN (SELECT id FROM rm) AND dst NOT IN (SELECT id FROM rm) GROUP BY relation""",
    "R17_upsert": """WITH n AS (SELECT c_custkey + 1 AS c_custkey, 'renamed' AS c_name, c_acctbal FROM customer WHERE c_custkey % 7 = 0), u AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n)
        SELECT * FROM u WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0)""",
    "S18_stacks": """WITH f AS (SELECT DISTINCT 'repo' || CAST(o_custkey % 300 AS VARCHAR) AS d, list_extract(['package.json', 'go.mod', 'Cargo.toml', 'pom.xml', 'setup.py', 'notes.md', 'requirements.txt'], CAST(o_orderkey % 7 + 1 AS INT)) AS b FROM orders),
        p(b, pr, stack) AS (VALUES ('package.json', 0, 'node'), ('go.mod', 1, 'go'), ('Cargo.toml', 2, 'rust'), ('pom.xml', 3, 'java'), ('setup.py', 7, 'python'), ('requirements.txt', 8, 'python')) SELECT d AS directory, arg_min(stack, pr) AS stack FROM f JOIN p USING (b) GROUP BY d""",
    "F1_F10_names": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source, lang FROM documents) SELECT doc_id, CASE WHEN t = '' THEN '_unnamed' ELSE translate(t, '/\\:*?"<>|', '_________') END AS file_name,
        regexp_replace(regexp_replace(lower(trim(t)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, lower(replace(replace(trim(source), ' ', '-'), '/', '-')) AS tag, 'Node' AS label, 'CALLS' AS relation, lang AS language, true AS code FROM d""",
    "B5_shared_suffix": """WITH p AS (SELECT page_id, list_transform(string_split(lower(trim(url)), '/'), lambda x: x) AS a FROM pages) SELECT page_id, CASE WHEN len(a) >= 2 THEN 2 ELSE 1 END::INT AS score, CASE WHEN a[-1] = 'b' THEN 1 ELSE 0 END::INT AS none FROM p""",
    "W4_select_repos": f"""WITH {_TERMS}, t(tok) AS (VALUES ('an'), ('nation_1'), ('brand#1')) SELECT repo, sum(CASE term_kind WHEN 'name' THEN 3.0 WHEN 'service' THEN 2.5 WHEN 'domain' THEN 1.5 ELSE 1.0 END)::DOUBLE AS score
        FROM terms JOIN t ON contains(lower(term), tok) GROUP BY repo_key, repo ORDER BY score DESC, repo_key LIMIT 10""",
    "W2_materialize": f"""WITH {_TERMS} SELECT CASE WHEN term_kind = 'name' THEN 'repo' ELSE term_kind END AS what, count(DISTINCT lower(trim(term))) AS n FROM terms GROUP BY term_kind
        UNION ALL SELECT CASE term_kind WHEN 'service' THEN 'exposes' WHEN 'package' THEN 'hosts' ELSE 'owns' END, count(DISTINCT (repo, lower(trim(term)))) FROM terms WHERE term_kind <> 'name' GROUP BY term_kind""",
    "B2_B4_bindings": f"""WITH {SUPPLY}, t AS (SELECT DISTINCT {_TARGET_EXPR} AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        fl AS (SELECT id, lower(file) AS p, split_part(lower(file), '/', -1) AS b FROM nodes WHERE kind = 'file'),
        f AS (SELECT target, lower(substr(target, 11)) AS ref FROM t WHERE starts_with(target, 'repo:file:')), fx AS (SELECT target, ref, fl.id AS exact FROM f LEFT JOIN fl ON fl.p = ref), fb AS (SELECT target, count(*) AS n, min(id) AS id FROM fx JOIN fl ON fl.b = split_part(ref, '/', -1) WHERE exact IS NULL GROUP BY target),
        sy AS (SELECT lower(label) AS k, count(DISTINCT id) AS n, min(id) AS id FROM nodes WHERE kind NOT IN ('file', 'project', 'repo') GROUP BY 1), rp AS (SELECT lower(label) AS k, count(DISTINCT id) AS n, min(id) AS id FROM nodes WHERE kind IN ('repo', 'project') GROUP BY 1)
        SELECT target, CASE WHEN exact IS NOT NULL THEN 'current' WHEN n IS NULL THEN 'stale' WHEN n = 1 THEN 'redirected' ELSE 'ambiguous' END AS state, CASE WHEN exact IS NOT NULL THEN exact WHEN n = 1 THEN fb.id END AS bound_target,
            CASE WHEN exact IS NOT NULL THEN 'exact file path match' WHEN n IS NULL THEN 'no live file candidate matched the historical path' WHEN n = 1 THEN 'unique basename match' ELSE 'multiple live files share the historical basename' END AS evidence FROM fx LEFT JOIN fb USING (target)
        UNION ALL SELECT target, CASE WHEN n IS NULL THEN 'stale' WHEN n = 1 THEN 'current' ELSE 'ambiguous' END, CASE WHEN n = 1 THEN sy.id END, CASE WHEN n IS NULL THEN 'no live symbol label matched the historical reference' WHEN n = 1 THEN 'unique symbol label match' ELSE 'multiple live symbols share the historical label' END
            FROM t LEFT JOIN sy ON lower(substr(target, 13)) = k WHERE starts_with(target, 'repo:symbol:')
        UNION ALL SELECT target, CASE WHEN n IS NULL THEN 'stale' WHEN n = 1 THEN 'current' ELSE 'ambiguous' END, CASE WHEN n = 1 THEN rp.id END, CASE WHEN n IS NULL THEN 'workspace repo no longer exists in the live graph' WHEN n = 1 THEN 'exact workspace repo match' ELSE 'multiple workspace repos matched the historical reference' END
            FROM t LEFT JOIN rp ON lower(substr(target, 16)) = k WHERE starts_with(target, 'workspace:repo:')
        UNION ALL SELECT target, 'current', target, 'memory-internal reference' FROM t WHERE starts_with(target, 'concept:')""",
    "X21_references": r"""WITH d AS (SELECT doc_id, source, lang FROM documents), u AS (SELECT doc_id, 'file' AS kind, 'src/' || source || '/' || lang || '.md' AS target FROM d UNION ALL SELECT doc_id, 'function', 'Other' FROM d UNION ALL SELECT doc_id, 'function', 'Auth.Service' FROM d
        UNION ALL SELECT doc_id, 'concept', 'Topic ' || lang FROM d UNION ALL SELECT doc_id, 'observation', CAST(doc_id AS VARCHAR) FROM d UNION ALL SELECT doc_id, 'observation', '12' FROM d) SELECT DISTINCT * FROM u""",
    "T1_debounce": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS root, event_type, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY ts) AS k FROM e)
        SELECT root, count(DISTINCT event_type)::INT AS n_paths, count(*) AS events, min(ts) AS first_at FROM s GROUP BY root, k""",
}
