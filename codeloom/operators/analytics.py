"""Graph-health analytics (rows A1-A5, A8-A17, Q19, Q20). Aggregations and equi-joins; percentiles from a histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.identity import text
from codeloom.session import dealt, scratch

from .graph import first_labels, last_labels, resolved


def histogram(df: DataFrame, column: str, missing: str = "", lower: bool = False) -> DataFrame:
    """(key, n): counts of a column; empty and null count as ``missing``."""
    c = F.when(text(column) == "", F.lit(missing)).otherwise(F.col(column))
    return df.groupBy((F.lower(c) if lower else c).alias("key")).agg(F.count("*").alias("n"))


def edges_by_id(nodes: DataFrame, edges: DataFrame, rows: int = 0) -> DataFrame:
    """Edges with both ends looked up by id, then first label; src and dst are null where unresolved. ``rows``: as of ``resolved``."""
    labels = first_labels(nodes)
    return resolved(resolved(edges, nodes, "src", labels, rows), nodes, "dst", labels, rows)


def edge_quality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of edges, broken, resolution_rate, self_loops, duplicates (src -> dst, any relation)."""
    # parallel edges are looked up once, and what is looked up is counted, so that edges grow in tasks and not in what a task holds
    alike = scratch(edges.groupBy("src", "dst").agg(F.count("*").alias("n")), "alike")
    rows = alike.count()
    e = edges_by_id(nodes, alike, rows)
    pairs = dealt(e, rows, "src", "dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    whole = F.col("src").isNotNull() & F.col("dst").isNotNull()
    sums = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("edges"),
        F.coalesce(F.sum(F.when(whole, 0).otherwise(F.col("n"))), F.lit(0)).alias("broken"),
        F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0)).alias("self_loops"),
        F.coalesce(F.sum(F.when(whole, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
    )
    return sums.withColumn("resolution_rate", F.when(F.col("edges") > 0, (F.col("edges") - F.col("broken")) / F.col("edges")).otherwise(0.0))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1d: (id, out_degree, in_degree, degree) over resolved edges, parallel ones and self loops counted; every node."""
    e = edges_by_id(nodes, edges).where("src is not null and dst is not null")
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    n = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.count("*").alias("degree"))
    full = nodes.select("id").join(n, "id", "left").na.fill(0, ["out_degree", "degree"])
    return full.select("id", "out_degree", (F.col("degree") - F.col("out_degree")).alias("in_degree"), "degree")


def degree_stats(degree: DataFrame) -> DataFrame:
    """A1e: avg, upper median, p95 (discrete), max, isolated (0), leaf (1), hub (10 or more), connected_pct (floored).

    Ranks come from the histogram of degrees, which has as many rows as there are different degrees.
    """
    h = degree.groupBy("degree").agg(F.count("*").alias("n"))
    running = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(1))))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("degree")))
    return h.agg(
        (F.sum(F.col("degree") * F.col("n")) / F.sum("n")).alias("avg_degree"),
        at(F.floor(F.col("all") / 2)).alias("median_degree"),
        at(F.ceil(F.col("all") * 0.95) - 1).alias("p95_degree"),
        F.max("degree").alias("max_degree"),
        F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("n"))), F.lit(0)).alias("isolated"),
        F.coalesce(F.sum(F.when(F.col("degree") == 1, F.col("n"))), F.lit(0)).alias("leaves"),
        F.coalesce(F.sum(F.when(F.col("degree") >= 10, F.col("n"))), F.lit(0)).alias("hubs"),
        F.floor(100 * F.coalesce(F.sum(F.when(F.col("degree") > 0, F.col("n"))), F.lit(0)) / F.sum("n")).alias("connected_pct"),
    )


def community_stats(nodes: DataFrame) -> DataFrame:
    """A1f: communities, largest, singletons; zeros if every node is in community 0."""
    c = nodes.groupBy(F.coalesce("community", F.lit(0)).alias("c")).agg(F.count("*").alias("n"))
    clustered = F.coalesce(F.max(F.col("c") != 0), F.lit(False))
    zero = F.lit(0).cast("long")
    return c.agg(F.when(clustered, F.count("*")).otherwise(zero).alias("communities"), F.when(clustered, F.max("n")).otherwise(zero).alias("largest"), F.when(clustered, F.count_if(F.col("n") == 1)).otherwise(zero).alias("singletons"))


def modularity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1g: Newman's modularity of the communities over resolved edges, rounded to six places; 0 without edges."""
    e = edges_by_id(nodes, edges).where("src is not null and dst is not null").select("src", "dst")
    c = nodes.select("id", F.coalesce("community", F.lit(0)).alias("c"))
    e = e.join(c.withColumnsRenamed({"id": "src", "c": "cs"}), "src").join(c.withColumnsRenamed({"id": "dst", "c": "cd"}), "dst")
    pairs = e.groupBy("cs", "cd").agg(F.count("*").alias("n"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), F.when(F.col("cs") == F.col("cd"), F.col("n")).otherwise(0).alias("inner"), "n"), F.struct(F.col("cd").alias("c"), F.lit(0).cast("long").alias("inner"), "n"))).alias("x")).select("x.*")
    per = ends.groupBy("c").agg(F.sum("inner").alias("inner"), F.sum("n").alias("ends"))
    m = F.sum("ends") / 2
    q = F.sum("inner") / m - F.sum(F.col("ends") * F.col("ends")) / (4 * m * m)
    return per.agg(F.round(F.coalesce(q, F.lit(0.0)), 6).alias("modularity"))


def top_by_out_degree(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """A1h: by out-degree, then id."""
    return degrees(nodes, edges).join(nodes.select("id", "label", "kind"), "id").orderBy(F.desc("out_degree"), "id").limit(n).select("id", "label", "kind", "out_degree", "in_degree")


def simple_degrees(edges: DataFrame) -> DataFrame:
    """A3: (id, degree): different in-neighbours plus different out-neighbours, of nodes that have any."""
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    return pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def god_nodes(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """A2: the nodes of highest simple degree, ties by id."""
    d = nodes.select("id", "label", "kind").join(simple_degrees(edges), "id", "left").na.fill(0, ["degree"])
    return d.orderBy(F.desc("degree"), "id").limit(n)


def surprise_edges(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """A4: edges between communities by the product of simple degrees; ends looked up by id, then last label."""
    e = resolved(edges, nodes, "dst", last_labels(nodes)).where("dst is not null")
    c = nodes.select("id", F.coalesce("community", F.lit(0)).alias("c")).join(simple_degrees(edges), "id", "left").na.fill(0, ["degree"])
    e = e.select("src", "dst", "relation").distinct()
    j = e.join(c.withColumnsRenamed({"id": "src", "c": "cs", "degree": "ds"}), "src").join(c.withColumnsRenamed({"id": "dst", "c": "cd", "degree": "dd"}), "dst")
    j = j.where("cs <> cd").select("src", "dst", "relation", F.col("cs").alias("src_community"), F.col("cd").alias("dst_community"), (F.col("ds") * F.col("dd")).alias("score"))
    return j.orderBy(F.desc("score"), "src", "dst", "relation").limit(n)


# Questions about the two most connected nodes, and what stands for one that is missing.
QUESTIONS = [
    "What does {0} depend on, and what depends on it?",
    "What is the shortest dependency path from {0} to {1}?",
    "Which components would break if {0} changed its interface?",
    "Which communities are most isolated from the rest of the graph?",
    "What are the most unexpected cross-domain connections in this codebase?",
]
NO_NODE = "<node>"


def suggested_questions(gods: list[str]) -> list[str]:
    """A5: always all questions."""
    first, second = [*gods, NO_NODE, NO_NODE][:2]
    return [q.format(first, second) for q in QUESTIONS]


def neighbours(edges: DataFrame, nodes: DataFrame, subject: str) -> DataFrame:
    """Q19: (direction, id, label, relation); a self loop once, as outgoing."""
    e = edges_by_id(nodes, edges).where("src is not null and dst is not null")
    out = e.where(F.col("src") == subject).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), "relation")
    into = e.where((F.col("dst") == subject) & (F.col("src") != subject)).select(F.lit("in").alias("direction"), F.col("src").alias("id"), "relation")
    return out.unionByName(into).join(nodes.select("id", "label"), "id").select("direction", "id", "label", "relation")


def project_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project its nodes, files, symbols and outgoing edges.

    A node's project: its own id for a project, else its source id, else what stands before the first ``:``.
    """
    projects = nodes.where("kind = 'project'").select("id", F.regexp_extract("id", r"(?s)^project:(.*)$", 1).alias("project"), "label")
    own = F.when(F.col("kind") == "project", F.regexp_extract("id", r"(?s)^project:(.*)$", 1)).when(text("source_id") != "", F.col("source_id")).otherwise(F.substring_index("id", ":", 1))
    owned = nodes.select("id", "kind", own.alias("project"))
    symbol = ~F.col("kind").isin("file", "project")
    counts = owned.groupBy("project").agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "file").alias("files"), F.count_if(symbol).alias("symbols"))
    outgoing = edges.select(F.col("src").alias("id")).join(owned, "id").groupBy("project").agg(F.count("*").alias("outgoing"))
    return projects.drop("id").join(counts, "project", "left").join(outgoing, "project", "left").na.fill(0, ["nodes", "files", "symbols", "outgoing"])


def registry_rollup(status: DataFrame) -> DataFrame:
    """Totals over the rows of A11."""
    return status.agg(F.count("*").alias("projects"), F.count_if(F.col("nodes") > 0).alias("healthy"), F.count_if(F.col("nodes") == 0).alias("missing"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("nodes", "files", "symbols", "outgoing")])


def snapshot_deltas(snapshots: DataFrame, series: str, at: str, metrics: list[str]) -> DataFrame:
    """Each snapshot's metrics and their signed change since the one before in its series."""
    w = Window.partitionBy(series).orderBy(at)
    return snapshots.select(series, at, *metrics, *[(F.col(m) - F.lag(m).over(w)).alias(f"{m}_delta") for m in metrics])


# Node colours of the page.
PALETTE = ["#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac", "#86bcb6", "#d37295"]


def drawn_nodes(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """Size 10 to 40 by degree against the largest, colour by community. One number, the largest degree, is read first."""
    most = degree.agg(F.max("degree")).first()[0] or 0
    size = 10 + F.floor(30 * F.col("degree") / F.lit(most)) if most else F.lit(10).cast("long")
    colour = F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(F.coalesce("community", F.lit(0)), F.lit(len(PALETTE))) + 1).cast("int"))
    return nodes.select("id", "label", "community").join(degree.select("id", "degree"), "id").select("id", "label", "degree", size.alias("size"), colour.alias("colour"))


def organization_subgraph(nodes: DataFrame, edges: DataFrame, organization: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of one organization and of the memory layer, and the edges between them, targets by id or by label."""
    n = nodes.where((text("organization") == organization) | (F.col("layer") == "memory"))
    keys = n.select(F.col("id").alias("k")).unionByName(n.where(text("label") != "").select(F.col("label").alias("k"))).distinct()
    e = edges.join(n.select(F.col("id").alias("src")), "src", "left_semi").join(keys.withColumnRenamed("k", "dst"), "dst", "left_semi")
    return n, e.select(*edges.columns)
