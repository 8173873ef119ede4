"""Queries of rows T5, P5, Q7, Q8, Q9 and Q10 by incremental upkeep, the distance index and label setting, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.exports import documents
from codeloom.operators import ignore, reach_index, traverse, upkeep, workspace
from codeloom.operators.graph import Graph
from codeloom.session import scratch, shared_folder
from codeloom.sources import graph_json

from .projections import CANON, RAW_SUPPLY, SUPPLY, TRADE, supply, trade
from .structure import _F, _FILE_EXPRS, _TARGET_EXPR, _TERMS, _files, _terms
from .structure import SQL as SHORTEST

_OWNER_N = "CASE WHEN coalesce(file, '') <> '' THEN file ELSE id END"
_OWNER_E = "CASE WHEN coalesce(file, '') <> '' THEN file ELSE src END"
# by the digest of its owner a row is deleted, changed or new in the second version
_MARK = "substr(md5({owner}), 1, 2)"
_NEW_LABEL = "CASE WHEN {mark} < '10' THEN label || ' v2' ELSE label END"
_NEW_TARGET = "CASE WHEN {mark} < '10' AND ord % 2 = 0 THEN 'catalog:part:1' ELSE dst END"


def _versions(spark: SparkSession, sf: str) -> tuple[Graph, Graph]:
    """The supply graph before and after files were deleted, changed and added; rows with owner."""
    g = supply(spark, sf, raw=True)
    rows = {"n": g.nodes.withColumn("owner", F.expr(_OWNER_N)), "e": g.edges.withColumn("owner", F.expr(_OWNER_E))}
    # the joins behind the graph are made once, not once a version and change
    rows = {k: scratch(x, f"raw-{k}") for k, x in rows.items()}
    mark = _MARK.format(owner="owner")
    old = {k: x.where(f"{mark} < '10' or {mark} >= '18'") for k, x in rows.items()}
    new = {k: x.where(f"{mark} >= '08'") for k, x in rows.items()}
    new["n"] = new["n"].withColumn("label", F.expr(_NEW_LABEL.format(mark=mark)))
    new["e"] = new["e"].withColumn("dst", F.expr(_NEW_TARGET.format(mark=mark)))
    return Graph(old["n"], old["e"]), Graph(new["n"], new["e"])


def t5(spark: SparkSession, sf: str) -> DataFrame:
    """A build of the first version, then one change that reads, resolves and writes only what the second version's changed files touch."""
    old, new = _versions(spark, sf)
    state = upkeep.started(spark, f"{shared_folder(spark)}/upkeep-{uuid.uuid4().hex}", old.nodes, old.edges, buckets=32)
    mark = _MARK.format(owner="owner")
    touched = f"{mark} < '18'"
    owners = old.nodes.select("owner").unionByName(old.edges.select("owner")).where(touched)
    state = upkeep.changed(state, owners, new.nodes.where(touched), new.edges.where(touched))
    g = upkeep.graph_of(state)
    nodes = g.nodes.select(F.lit("node").alias("what"), "id", F.col("label").alias("target"), F.col("kind").alias("name"), F.col("file"))
    return nodes.unionByName(g.edges.select(F.lit("edge").alias("what"), F.col("src").alias("id"), F.concat_ws("|", "dst", "dst_label").alias("target"), F.col("relation").alias("name"), "file"))


SUBJECTS = ("part:7", "part:11", "nation:NATION_8", "order:1")


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return reach_index.distance_labels(trade(spark, sf))


def q7_index(spark: SparkSession, sf: str) -> DataFrame:
    """Impact of several subjects at once, from the labels of the whole trade graph."""
    return reach_index.all_from(_index(spark, sf), spark.createDataFrame([(s,) for s in SUBJECTS], "subject string"), reverse=True)


def q7_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Impact with the least of the shortest paths of each node."""
    found = traverse.impact_paths(trade(spark, sf), "part:7")
    return found.select("id", "hops", F.array_join("path", ">").alias("path"))


def q8_index(spark: SparkSession, sf: str) -> DataFrame:
    """Distances from every region to every node that it reaches."""
    regions = spark.read.parquet(f"{sf}/region.parquet").select(F.concat(F.lit("region:"), "r_name").alias("subject"))
    return reach_index.all_from(_index(spark, sf), regions)


def q8_path(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest path of Q8, hop by hop from the labels."""
    return reach_index.path(_index(spark, sf), trade(spark, sf), "region:EUROPE", "part:11")


def q7_components(spark: SparkSession, sf: str) -> DataFrame:
    """Strong components of the trade graph: a nation and its suppliers are one."""
    return reach_index.strong_components(trade(spark, sf))


def p5(spark: SparkSession, sf: str) -> DataFrame:
    """Pages under the rules of the root and of every host's folder, from a rule table."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    hosts = pages.select(F.substring_index("path", "/", 1).alias("folder")).where("folder <> ''").distinct()
    root = spark.createDataFrame(ignore.rule_rows("", [ignore.rules(["*.html", "!4*.html"])]), ignore.RULES)
    own = spark.createDataFrame([r[1:] for r in ignore.rule_rows("", [ignore.rules(["es/", "# note"])])], ignore.RULES.split(", ", 1)[1])
    table = root.unionByName(hosts.crossJoin(F.broadcast(own)))
    out = ignore.ignored_paths(pages.select("path").distinct(), table).withColumn("ignored", F.lit(True))
    return pages.join(out, "path", "left").select("page_id", F.coalesce("ignored", F.lit(False)).alias("ignored"))


def q17_all(spark: SparkSession, sf: str) -> DataFrame:
    """A question about every part, routed in one job."""
    asked = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS question_id", "'Which ' || p_brand || ' repos own ' || p_type || ' or ' || p_name || ' of NATION_' || CAST(p_size % 25 AS STRING) || '?' AS question")
    return workspace.route_all(_terms(spark, sf), asked, 5)


def r19_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The supply graph united with two changed copies of parts of it, row by row."""
    g = supply(spark, sf)
    second = Graph(g.nodes.where("community = 1").withColumn("label", F.upper("label")), g.edges.where("relation = 'contains'").withColumn("confidence", F.lit("DECLARED")))
    third = Graph(g.nodes.withColumn("id", F.concat(F.lit("copy:"), "id")), g.edges.where("ord % 3 = 0").withColumn("src", F.concat(F.lit("copy:"), "src")))
    u = Graph.union_all([second, g, third])
    nodes = u.nodes.select(F.lit("node").alias("what"), "id", F.col("label").alias("target"), "kind", F.lit("").alias("confidence"))
    return nodes.unionByName(u.edges.select(F.lit("edge").alias("what"), F.col("src").alias("id"), F.col("dst").alias("target"), F.col("relation").alias("kind"), F.coalesce("confidence", F.lit("")).alias("confidence")))


_DENSE = ("f7", "f13")


def q9_dense(spark: SparkSession, sf: str) -> DataFrame:
    """The best path over all file links, of which there are some thirty a file."""
    nodes, edges = _files(spark, sf)
    return traverse.ranked_file_path(nodes, edges, *_DENSE)


def k1_document(spark: SparkSession, sf: str) -> DataFrame:
    """The supply graph written as one document by tasks, and read again in ranges of bytes; rows of both tables."""
    path = f"{shared_folder(spark).removeprefix('file://')}/documents/{uuid.uuid4().hex}.json"
    documents.write_json(supply(spark, sf, raw=True), path)
    g = graph_json.read_graph(spark, path)
    nodes = g.nodes.select(F.lit("node").alias("what"), "id", F.col("label").alias("target"), F.col("kind").alias("name"), "file", F.col("community").cast("double").alias("value"))
    return nodes.unionByName(g.edges.select(F.lit("edge").alias("what"), F.col("src").alias("id"), F.col("dst").alias("target"), F.col("relation").alias("name"), "file", F.col("score").alias("value")))


QUERIES = {"T5_incremental_upkeep": t5, "Q7_impact_index": q7_index, "Q7_impact_paths": q7_paths, "Q8_distance_index": q8_index, "Q8_path_index": q8_path, "Q7_strong_components": q7_components, "Q9_ranked_path_dense": q9_dense, "P5_nested_ignored": p5, "Q17_route_all": q17_all, "R19_union_rows": r19_rows, "K1_S1_document": k1_document}


def _root(p: str) -> str:
    cut = lambda n: f"array_to_string(string_split({p}, '/')[1:{n}], '/') || '/'"
    return (
        f"CASE WHEN {p} = '' THEN '' WHEN regexp_matches({p}, '^packages/[^/]*/') THEN {cut(3)} WHEN regexp_matches({p}, '^packages/[^/]*$') THEN 'packages/' "
        f"WHEN starts_with({p}, 'internal/') OR starts_with({p}, 'cmd/') THEN {cut(2)} ELSE regexp_extract({p}, '^(.*/)[^/]*$', 1) END"
    )


def _inner(p: str) -> str:
    """Points of an inner file; ``s`` and ``t`` are the roots of the ends."""
    base = f"regexp_extract({p}, '([^/]*)$', 1)"
    when = lambda c, n: f"(CASE WHEN {c} THEN {n} ELSE 0 END)"
    return " + ".join([
        when(f"t <> '' AND starts_with({p}, t)", 40), when(f"starts_with({base}, 'index.')", 30), when(f"{base} = 'config.go'", 25), when(f"{base} = 'types.go'", 10),
        when(f"s <> '' AND t <> '' AND s <> t AND starts_with({p}, s)", -20), when(f"contains({p}, '/domain/')", -15),
        when(f"contains({p}, '/context/') AND NOT contains({p}, '/presentation/context/') AND NOT contains({p}, '/shared/contexts/')", -10),
    ])


def _ranked(source: str, target: str) -> str:
    """After files(id, file) and links(src, dst): the best walk, level by level; a walk that meets no file twice is the best path too."""
    out = [
        f"named AS (SELECT id, lower(trim(file)) AS p FROM files), ends AS (SELECT (SELECT {_root('p')} FROM named WHERE id = '{source}') AS s, (SELECT {_root('p')} FROM named WHERE id = '{target}') AS t)",
        f"near AS (SELECT DISTINCT src, dst, {_inner('p')} AS w, t <> '' AND starts_with(p, t) AS ins FROM links JOIN named ON id = dst, ends WHERE dst <> '{source}' AND src IN (SELECT id FROM files))",
        f"l1 AS (SELECT '{source}' AS id, true AS inside, 0 AS score, ['{source}'] AS ids)",
    ]
    for n in range(2, 9):
        bonus = "+ 10 + CASE WHEN inside THEN 20 ELSE 0 END" if n > 2 else ""
        out.append(f"d{n} AS (SELECT {n} AS n, score - {n} {bonus} AS score, list_append(ids, dst) AS ids FROM l{n - 1} JOIN near ON src = id WHERE dst = '{target}')")
        out.append(f"g{n} AS (SELECT dst AS id, inside AND ins AS inside, score + w AS score, list_append(ids, dst) AS ids FROM l{n - 1} JOIN near ON src = id WHERE dst <> '{target}')")
        out.append(f"l{n} AS (SELECT * FROM g{n} QUALIFY row_number() OVER (PARTITION BY id, inside ORDER BY score DESC, ids) = 1)")
    out.append("done AS (" + " UNION ALL ".join(f"SELECT * FROM d{n}" for n in range(2, 9)) + ")")
    out.append("best AS (SELECT ids FROM done WHERE n <= least((SELECT min(n) FROM done) + 3, 8) ORDER BY score DESC, n, ids LIMIT 1)")
    return ", ".join(out) + " SELECT (unnest(range(len(ids))))::INT AS hop, unnest(ids) AS id FROM best"


_MARK_N, _MARK_E = _MARK.format(owner=_OWNER_N), _MARK.format(owner=_OWNER_E)
_BOTH = RAW_SUPPLY.replace("nodes AS (", "given_n AS (", 1).replace(", edges AS (", ", given_e AS (", 1)
_WALKS = "walk AS ({start} UNION SELECT subject, {to}, hops + 1 FROM walk JOIN edges ON {at} = walk.id WHERE hops < 8)"

SQL = {
    "T5_incremental_upkeep": f"""WITH {_BOTH},
        nodes AS (SELECT * REPLACE ({_NEW_LABEL.format(mark=_MARK_N)} AS label) FROM given_n WHERE {_MARK_N} >= '08'),
        edges AS (SELECT * REPLACE ({_NEW_TARGET.format(mark=_MARK_E)} AS dst) FROM given_e WHERE {_MARK_E} >= '08'), {CANON}
        SELECT 'node' AS what, id, label AS target, kind AS name, file FROM cn
        UNION ALL SELECT 'edge', src, b.dst || '|' || n.label, relation, coalesce(b.file, '') FROM built b JOIN cn n ON n.id = b.dst""",
    "Q7_impact_index": f"""WITH RECURSIVE {TRADE}, {_WALKS.format(start="SELECT unnest([" + ", ".join(f"'{x}'" for x in SUBJECTS) + "]) AS subject, subject AS id, 0 AS hops", to="src", at="dst")}
        SELECT subject, id, min(hops) AS hops FROM walk WHERE id <> subject GROUP BY ALL""",
    "Q7_impact_paths": f"""WITH RECURSIVE {TRADE}, walk AS (SELECT 'part:7' AS id, ['part:7'] AS p UNION SELECT src, list_prepend(src, p) FROM walk JOIN edges ON dst = walk.id WHERE NOT list_contains(p, src) AND len(p) < 8),
        least AS (SELECT id, p FROM walk WHERE id <> 'part:7' QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(p), p) = 1) SELECT id, (len(p) - 1)::INT AS hops, array_to_string(p, '>') AS path FROM least""",
    "Q8_distance_index": f"""WITH RECURSIVE {TRADE}, {_WALKS.format(start="SELECT 'region:' || r_name AS subject, 'region:' || r_name AS id, 0 AS hops FROM region", to='dst', at='src')}
        SELECT subject, id, min(hops) AS hops FROM walk WHERE id <> subject GROUP BY ALL""",
    "Q7_strong_components": f"""WITH {TRADE}, ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges),
        ring AS (SELECT src AS supplier, dst AS nation FROM edges WHERE relation = 'based_in'), least AS (SELECT nation, least(nation, min(supplier)) AS c FROM ring GROUP BY nation),
        inring AS (SELECT nation AS id, c FROM least UNION SELECT supplier, c FROM ring JOIN least USING (nation))
        SELECT ids.id, coalesce(c, ids.id) AS component FROM ids LEFT JOIN inring ON ids.id = inring.id""",
    "P5_nested_ignored": """SELECT page_id, coalesce(len([x for x in w if x LIKE '%.html' AND x NOT LIKE '4%.html']) > 0 OR list_contains(w[2:len(w) - 1], 'es'), false) AS ignored
        FROM (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS w FROM pages)""",
    "Q9_ranked_path_dense": f"WITH {_F}, {_ranked(*_DENSE)}",
    "Q9_ranked_path": f"""WITH files AS (SELECT {", ".join(_FILE_EXPRS)} FROM part),
        links AS (SELECT 'f' || CAST(p_partkey AS STRING) AS src, 'f' || CAST(unnest([p_partkey * 2, p_partkey * 2 + 1, p_partkey + 1]) AS STRING) AS dst FROM part), {_ranked('f2', 'f45')}""",
}
_SUM = "sum({n} CASE term_kind WHEN 'name' THEN 3.0 WHEN 'service' THEN 2.5 WHEN 'domain' THEN 1.5 ELSE 1.0 END)::DOUBLE"
SQL["Q17_route"] = f"""WITH {_TERMS}, t(tok) AS (VALUES ('which'), ('nation'), ('1'), ('repos'), ('do'), ('machinery'))
        SELECT repo, {_SUM.format(n='')} AS score FROM terms JOIN t ON contains(lower(term), tok) GROUP BY repo_key, repo ORDER BY score DESC, repo_key LIMIT 10"""
SQL["Q17_route_all"] = f"""WITH {_TERMS}, q AS (SELECT p_partkey AS question_id, 'Which ' || p_brand || ' repos own ' || p_type || ' or ' || p_name || ' of NATION_' || CAST(p_size % 25 AS STRING) || '?' AS question FROM part),
        asked AS (SELECT question_id, tok, count(*) AS n FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS tok FROM q) GROUP BY ALL),
        worth AS (SELECT tok, repo_key, repo, {_SUM.format(n='')} AS w FROM terms JOIN (SELECT DISTINCT tok FROM asked) ON contains(lower(term), tok) GROUP BY ALL)
        SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY sum(w * n) DESC, repo_key)::INT AS rank, repo, sum(w * n) AS score FROM asked JOIN worth USING (tok) GROUP BY question_id, repo_key, repo QUALIFY rank <= 5"""
SQL["Q16_bound_references"] = f"""WITH b AS ({SHORTEST["B2_B4_bindings"]}), s AS (SELECT s_suppkey, {_TARGET_EXPR} AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT CASE WHEN s_suppkey % 6 = 5 THEN 'none' ELSE state END AS state, CASE WHEN s_suppkey % 6 = 5 THEN NULL WHEN state IN ('current', 'redirected') THEN true ELSE s.target = bound_target END AS moved, count(*) AS n
        FROM s LEFT JOIN b ON b.target = s.target GROUP BY ALL"""
SQL["R19_union_rows"] = f"""WITH {SUPPLY}, un AS (SELECT id, upper(label) AS label, kind, 0 AS g, ord FROM nodes WHERE community = 1 UNION ALL SELECT id, label, kind, 1, ord FROM nodes UNION ALL SELECT 'copy:' || id, label, kind, 2, ord FROM nodes),
        ue AS (SELECT src, dst, relation, file, 'DECLARED' AS confidence, 0 AS g, ord FROM edges WHERE relation = 'contains' UNION ALL SELECT src, dst, relation, file, confidence, 1, ord FROM edges UNION ALL SELECT 'copy:' || src, dst, relation, file, confidence, 2, ord FROM edges WHERE ord % 3 = 0),
        n1 AS (SELECT * FROM un QUALIFY row_number() OVER (PARTITION BY id ORDER BY g, ord) = 1),
        e1 AS (SELECT * FROM ue WHERE src IN (SELECT id FROM n1) QUALIFY row_number() OVER (PARTITION BY src, dst, relation, file ORDER BY g, ord) = 1)
        SELECT 'node' AS what, id, label AS target, kind, '' AS confidence FROM n1 UNION ALL SELECT 'edge', src, dst, relation, coalesce(confidence, '') FROM e1"""
#: Of each level of a path, the last rule that matches it; levels above the last are folders.
SQL["P1_P4_ignored"] = """SELECT page_id, list_contains([CASE WHEN k < len(w) AND w[k] = 'es' THEN true WHEN w[k] LIKE 'blog.%' THEN true WHEN k = 2 AND k < len(w) AND w[1] LIKE 'www.%' AND w[k] = 'en' THEN true
            WHEN w[k] LIKE '4%.html' THEN false ELSE w[k] LIKE '%.html' END for k in range(1, len(w) + 1)], true) AS ignored
        FROM (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS w FROM pages)"""
SQL["Q8_path_index"] = SHORTEST["Q8_shortest_path"]
SQL["K1_S1_document"] = f"""WITH {RAW_SUPPLY}, {CANON} SELECT 'node' AS what, id, coalesce(label, '') AS target, coalesce(kind, '') AS name, coalesce(file, '') AS file, CAST(coalesce(community, 0) AS DOUBLE) AS value FROM cn
    UNION ALL SELECT 'edge', src, dst, coalesce(relation, ''), coalesce(file, ''), CAST(coalesce(score, 0) AS DOUBLE) FROM ce"""
