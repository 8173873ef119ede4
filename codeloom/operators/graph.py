"""Property graph: cleaning, resolution, merging and pruning (rows R1-R9, R13-R16, R19, A7, X25).

A graph is two tables. ``nodes``: id, label, kind, file and ord at least; ``edges``: src, dst, relation, confidence, score,
file and ord at least. ``ord`` is the order of appearance; ties break on the other columns. "First wins" is a grouped minimum
of a struct led by ord, which combines on the map side, never a window over the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.identity import canonical_join_key, evidence_confidence, evidence_weight, label_of_id, text
from codeloom.session import dealt, scratch


def first_per(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The row of least ``order`` (default: ord, then all other columns) for each key."""
    lead = order or ["ord"]
    rest = [c for c in df.columns if c not in keys and c not in lead]
    first = df.groupBy(*keys).agg(F.min(F.struct(*lead, *rest)).alias("__first"))
    return first.select(*[c if c in keys else F.col("__first")[c].alias(c) for c in df.columns])


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    """No empty id, the first of each id."""
    return first_per(nodes.where(text("id") != ""), ["id"])


def canonical_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """R2: no empty end, a known source, the first of each (src, dst, relation, file). Targets are not looked up."""
    known = edges.where((text("src") != "") & (text("dst") != "")).join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return first_per(known.select(*edges.columns).withColumn("file", text("file")), ["src", "dst", "relation", "file"])


def first_labels(nodes: DataFrame) -> DataFrame:
    """(label, label_id): the first node of each label."""
    return nodes.where(text("label") != "").groupBy("label").agg(F.min_by("id", F.struct("ord", "id")).alias("label_id"))


def last_labels(nodes: DataFrame) -> DataFrame:
    """(label, label_id): the last node of each label."""
    return nodes.where(text("label") != "").groupBy("label").agg(F.max_by("id", F.struct("ord", "id")).alias("label_id"))


def resolved(edges: DataFrame, nodes: DataFrame, column: str = "dst", labels: DataFrame | None = None, rows: int = 0) -> DataFrame:
    """``column`` replaced by a node id: itself if it is one, else the node of that label, else null. The old value stays in <column>_raw.

    ``rows``: how many edges there are, if that was counted; then they are dealt into parts of bounded size.
    """
    ids = dealt(nodes.select(F.col("id").alias("__id")), rows, "__id").distinct()
    by_label = (first_labels(nodes) if labels is None else labels).select(F.col("label").alias("__label"), F.col("label_id").alias("__by_label"))
    by_label = dealt(by_label, rows, "__label")
    edges = edges.drop(f"{column}_raw")
    out = dealt(edges.withColumnRenamed(column, "__raw"), rows, "__raw")
    out = out.join(ids, out["__raw"] == ids["__id"], "left").join(by_label, out["__raw"] == by_label["__label"], "left")
    return out.select(*[F.coalesce("__id", "__by_label").alias(column) if c == column else F.col(c) for c in edges.columns], F.col("__raw").alias(f"{column}_raw"))


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def canonicalized(self) -> Graph:
        nodes = canonical_nodes(self.nodes)
        return Graph(nodes, canonical_edges(self.edges, nodes))

    def built(self) -> Graph:
        """Canonical, targets resolved by id, then by first label; unresolved and self edges dropped, parallel ones kept.

        dst is the node's id; dst_label is its label.
        """
        g = Graph(self.nodes, self.edges.drop("dst_label")).canonicalized()
        e = resolved(g.edges, g.nodes).where("dst is not null and src <> dst")
        labels = g.nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
        return Graph(g.nodes, e.join(labels, "dst").select(*[c for c in e.columns], "dst_label"))

    def linked(self) -> Graph:
        """The nodes of ``built`` and its edges as different (src, dst, relation): parallel ones count once, so none has to win and nothing else is carried."""
        nodes = canonical_nodes(self.nodes)
        known = self.edges.where((text("src") != "") & (text("dst") != "")).join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
        e = resolved(known.select("src", "dst", "relation").distinct(), nodes).where("dst is not null and src <> dst")
        return Graph(nodes, e.select("src", "dst", "relation").distinct())

    def parallel(self) -> Graph:
        """The nodes of ``built`` and its edges as (src, dst, relation, file, dst_raw), parallel ones kept: different rows are told apart by hash, no copy is sorted out as first and nothing else is carried."""
        nodes = canonical_nodes(self.nodes)
        known = self.edges.where((text("src") != "") & (text("dst") != "")).join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
        e = resolved(known.select("src", "dst", "relation", text("file").alias("file")).distinct(), nodes)
        return Graph(nodes, e.where("dst is not null and src <> dst"))

    def union(self, other: Graph) -> Graph:
        """Rows of both, those of ``other`` after, canonicalised."""
        return Graph.union_all([self, other])

    @staticmethod
    def union_all(graphs: list[Graph]) -> Graph:
        """The rows of all graphs, earlier graphs first, canonicalised once: the shuffles do not grow with their number.

        The source of an edge may be a node of any of them.
        """

        def every(tables: list[DataFrame]) -> DataFrame:
            marked = [t.withColumn("__g", F.lit(k)) for k, t in enumerate(tables)]
            while len(marked) > 1:  # pairwise, so that the plan is as deep as a logarithm
                marked = [marked[k].unionByName(marked[k + 1]) if k + 1 < len(marked) else marked[k] for k in range(0, len(marked), 2)]
            return marked[0]

        nodes = first_per(every([g.nodes for g in graphs]).where(text("id") != ""), ["id"], ["__g", "ord"])
        edges = every([g.edges for g in graphs])
        known = edges.where((text("src") != "") & (text("dst") != "")).join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
        edges = first_per(known.select(*edges.columns), ["src", "dst", "relation", "file"], ["__g", "ord"])
        return Graph(nodes.drop("__g"), edges.drop("__g"))


def merge_facts(graph: Graph, facts: DataFrame) -> Graph:
    """``facts(from_id, to_id, kind, provenance, ord)``; stub nodes for unknown ends, an edge for each unseen (src, kind, dst).

    Evidence is that of the last provenance: its source, else its driver, else ``semantic``; confidence ``extracted`` if none.
    Returned nodes: id, label, kind, ord; edges: src, dst, relation, evidence_type, evidence_confidence, evidence_artifact, ord.
    """
    known = facts.where(F.trim(text("from_id")) != "")
    ends = known.select(F.col("from_id").alias("id"), "ord").unionByName(known.where(F.trim(text("to_id")) != "").select(F.col("to_id").alias("id"), "ord"))
    new = ends.groupBy("id").agg(F.min("ord").alias("ord")).join(graph.nodes.select("id"), "id", "left_anti")
    nodes = graph.nodes.select("id", "label", "kind", F.lit(0).alias("part"), "ord").unionByName(new.select("id", label_of_id(F.col("id")).alias("label"), F.lit("symbol").alias("kind"), F.lit(1).alias("part"), "ord"))
    last = F.try_element_at("provenance", F.lit(-1))
    given = known.where(F.trim(text("to_id")) != "").select(
        F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("kind").alias("relation"), "ord",
        F.coalesce(F.nullif(F.trim(text(last["source"])), F.lit("")), F.nullif(F.trim(text(last["driver"])), F.lit("")), F.lit("semantic")).alias("evidence_type"),
        F.coalesce(F.nullif(text(last["confidence"]), F.lit("")), F.lit("extracted")).alias("evidence_confidence"),
        F.trim(text(last["artifact"])).alias("evidence_artifact"),
    )
    fresh = first_per(given.join(graph.edges.select("src", "dst", "relation").distinct(), ["src", "dst", "relation"], "left_anti").select(*given.columns), ["src", "dst", "relation"])
    own = graph.edges.select("src", "dst", "relation", "ord", *[F.lit(None).cast("string").alias(c) for c in ("evidence_type", "evidence_confidence", "evidence_artifact")])
    return Graph(nodes, own.unionByName(fresh))


def edge_strength(edges: DataFrame) -> Column:
    """R7 as one ordered value, least first: strongest weight, then score, then canonical key, then what came first."""
    column = {c: F.col(c) if c in edges.columns else F.lit(None).cast("string") for c in ("evidence_confidence", "verification")}
    score = F.coalesce("score", F.lit(0.0))
    weight = evidence_weight(evidence_confidence(column["evidence_confidence"], F.col("confidence")), text(column["verification"]), score)
    none = F.lit("")
    key = F.concat(canonical_join_key(F.col("src"), none, none), F.col("relation"), canonical_join_key(F.col("dst"), none, none))
    return F.struct((-weight).alias("w"), (-score).alias("s"), key.alias("k"), F.col("part").alias("p"), F.col("ord").alias("o"))


def strongest(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edge of best evidence for each key."""
    return edges.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in edges.columns if c not in keys]), edge_strength(edges)).alias("__best")).select(*keys, "__best.*")


def merge_contract(graph: Graph, contract: Graph) -> Graph:
    """Nodes of the repository first; edges by (src, dst, relation), stronger evidence wins, the contract's among equals."""
    nodes = graph.nodes.withColumn("part", F.lit(0)).unionByName(contract.nodes.withColumn("part", F.lit(1)))
    edges = contract.edges.withColumn("part", F.lit(0)).unionByName(graph.edges.withColumn("part", F.lit(1)))
    known = edges.where((text("src") != "") & (text("dst") != ""))
    return Graph(first_per(nodes.where(text("id") != ""), ["id"], ["part", "ord"]).drop("part"), strongest(known, ["src", "dst", "relation"]).drop("part"))


def pruned(graph: Graph, deleted: DataFrame) -> Graph:
    """Without the nodes of ``deleted(path)``, the edges of these files and the edges at a removed node.

    A file node also goes by its label and by what follows ``:file:`` in its id (R14). One equi-join of candidate paths.
    """
    from codeloom.functions.text import graph_path

    gone = deleted.select(graph_path(F.col("path")).alias("__path")).where("__path <> ''").distinct()
    is_file = F.col("kind") == "file"
    suffix = F.when(is_file & F.col("id").contains(":file:"), F.regexp_extract("id", r"(?s):file:(.*)$", 1))
    names = F.array_distinct(F.array_compact(F.array(F.col("file"), F.when(is_file, F.col("label")), suffix)))
    candidates = graph.nodes.select("id", F.explode(names).alias("__name")).select("id", graph_path(F.col("__name")).alias("__path"))
    removed = candidates.join(gone, "__path", "left_semi").select("id").distinct()
    nodes = graph.nodes.join(removed, "id", "left_anti").select(*graph.nodes.columns)
    edges = graph.edges.withColumn("__path", graph_path(F.col("file"))).join(gone, "__path", "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(removed.withColumnRenamed("id", end), end, "left_anti")
    return Graph(nodes, edges.select(*graph.edges.columns))


def file_projection(graph: Graph) -> DataFrame:
    """Every edge but ``contains`` lifted to the files of its ends, as ``depends_on``; the first of each pair names what it came from.

    The target is a node by id, else the first of that label. A symbol's file node is the node ``<source name>:file:<file>``, else the
    file whose label is its file.
    """
    # written and counted, so that edges grow in tasks and not in what a task holds
    e = scratch(graph.edges.where("relation <> 'contains'").select("src", "dst", "relation", "ord"), "lifted-edges")
    rows = e.count()
    e = resolved(e, graph.nodes, rows=rows).where("dst is not null").drop("dst_raw")
    files = graph.nodes.where("kind = 'file'")
    source = text("source_name") if "source_name" in graph.nodes.columns else F.lit("")
    file_id = F.when((source != "") & (text("file") != ""), F.concat(source, F.lit(":file:"), F.col("file")))
    of = graph.nodes.select("id", F.when(F.col("kind") == "file", F.col("id")).alias("own"), F.col("file").alias("__file"), file_id.alias("__named"))
    by_label = first_labels(files).select(F.col("label").alias("__file"), "label_id")
    named = graph.nodes.select(F.col("id").alias("__named"), F.lit(True).alias("__there")).distinct()
    owner = dealt(dealt(of, rows, "__file").join(dealt(by_label, rows, "__file"), "__file", "left"), rows, "__named").join(dealt(named, rows, "__named"), "__named", "left")
    owner = owner.select("id", F.coalesce("own", F.when(F.col("__there"), F.col("__named")), "label_id").alias("owner")).where("owner is not null")
    owner = scratch(owner, "owners")
    lifted = e
    for end in ("dst", "src"):
        lifted = dealt(lifted, rows, end).join(dealt(owner.withColumnsRenamed({"id": end, "owner": f"{end}_file"}), rows, end), end).drop(end)
    lifted = dealt(lifted.where("src_file <> dst_file"), rows, "src_file", "dst_file")
    pairs = lifted.groupBy("src_file", "dst_file").agg(F.min(F.struct("ord", "relation")).alias("f"))
    return pairs.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"), F.lit("depends_on").alias("relation"), F.col("f.relation").alias("projected_from"), F.col("f.ord").alias("ord"))


def matches(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, id, tier, layer_rank, ord) of each node that a ``refs(ref, layer)`` row can mean.

    Tiers: id 1, canonical key 2, label 3, lowered label 4; within one, nodes of the asked layer come first. Four equi-joins.
    """
    none = F.lit("")
    n = nodes.select("id", "label", "layer", "ord", canonical_join_key(F.col("id"), F.col("kind"), text("source_name")).alias("canonical"))
    r = refs.select("ref", F.coalesce("layer", none).alias("asked"), F.trim("ref").alias("__t"))
    r = r.withColumn("__canonical", canonical_join_key(F.col("__t"), none, none))
    tiers = [(F.col("__t"), F.col("id")), (F.col("__canonical"), F.col("canonical")), (F.col("__t"), F.col("label")), (F.lower("__t"), F.lower("label"))]
    found = None
    for tier, (left, right) in enumerate(tiers, 1):
        hit = r.withColumn("__k", left).join(n.withColumn("__k", right), "__k").select("ref", "id", F.lit(tier).alias("tier"), F.when(F.col("asked") == F.col("layer"), 0).otherwise(1).alias("layer_rank"), "ord")
        found = hit if found is None else found.unionByName(hit)
    return found.where(F.trim("ref") != "")


def resolve_one(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, id, tier), the best node of each reference."""
    best = matches(nodes, refs).groupBy("ref").agg(F.min(F.struct("tier", "layer_rank", "ord", "id")).alias("b"))
    return best.select("ref", "b.id", "b.tier")


def resolve_all(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """I8: (ref, id, tier), all nodes of the best tier."""
    m = matches(nodes, refs).select("ref", "id", "tier").distinct()
    best = m.groupBy("ref").agg(F.min("tier").alias("tier"))
    return m.join(best, ["ref", "tier"]).select("ref", "id", "tier")
