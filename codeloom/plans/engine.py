"""The query surface (rows Q1, Q14-Q18, L5, H18): requests run on a graph and return rows; renderers make text of few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.identity import canonical_join_key, evidence_confidence, node_layer, text
from codeloom.operators import analytics, graph, lookup, reach_index, traverse, workspace
from codeloom.session import scratch

from .router import QueryRequest, parse_question

_EVIDENCE = [("layer", "layer"), ("type", "evidence_type"), ("artifact", "evidence_artifact"), ("confidence", None), ("verification", "verification"), ("reference", "reference_target"), ("bound", "bound_target"), ("binding", "binding_evidence")]


class NotFound(LookupError):
    pass


def described(label: Column, id_: Column, layer: Column, kind: Column) -> Column:
    """Q15: ``label [layer/kind]``."""
    name = F.coalesce(F.nullif(F.trim(text(label)), F.lit("")), id_)
    inside = F.array_join(F.filter(F.array(text(layer), F.trim(text(kind))), lambda x: x != ""), "/")
    return F.when(inside == "", name).otherwise(F.concat(name, F.lit(" ["), inside, F.lit("]")))


# The verbs of text queries.
VERBS = ["path <from> <to>", "explain <node>", "bindings <node>", "route <query>", "lookup <term>", "nodes", "edges", "help"]


class Engine:
    """A graph whose edge targets are resolved to ids where they can be."""

    def __init__(self, g: graph.Graph, terms: DataFrame | None = None, labels: DataFrame | None = None) -> None:
        """``labels``: the distance index of the resolved edges (``index``), if there is one; impact and shortest paths are then joins on it."""
        columns = {c: F.col(c) if c in g.nodes.columns else F.lit("") for c in ("layer", "source_name", "source_type", "description", "file")}
        self.nodes = g.nodes.withColumns(columns)
        known = graph.resolved(g.edges, self.nodes)
        self.edges = known.withColumn("dst", F.coalesce("dst", "dst_raw"))
        self.terms, self.labels = terms, labels
        self.spark = g.nodes.sparkSession

    def _ref(self, ref: str, layer: str = "") -> DataFrame:
        return self.spark.createDataFrame([(ref, layer)], "ref string, layer string")

    def resolve(self, ref: str, layer: str = "") -> str:
        row = graph.resolve_one(self.nodes, self._ref(ref, layer)).first()
        if row is None:
            near = [r.label for r in lookup.lookup(self.nodes, ref, 3).collect()]
            raise NotFound(f"node {ref!r} not found" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return row.id

    def _is_file(self, id_: str) -> bool:
        return not self.nodes.where((F.col("id") == id_) & (F.col("kind") == "file")).isEmpty()

    def file_edges(self) -> DataFrame:
        files = self.nodes.where("kind = 'file'").select("id")
        e = self.edges.where("relation <> 'contains'")
        return e.join(files.withColumnRenamed("id", "src"), "src", "left_semi").join(files.withColumnRenamed("id", "dst"), "dst", "left_semi")

    def run(self, request: QueryRequest) -> DataFrame:
        """Q1. dependencies and reverse: (position, id, relation); impact: (id, hops); path: (hop, id); explain: edge rows."""
        r = request.checked()
        if r.kind == "explain":
            return self.explain(r.subject).limit(r.limit)
        subject = self.resolve(r.subject)
        if r.kind == "path":
            return self.path(subject, self.resolve(r.target))
        if r.kind == "impact":
            return self.impacted(subject).join(self.nodes.select("id", "ord"), "id").orderBy("ord", "id").limit(r.limit).select("id", "hops")
        reverse = r.kind == "reverse_dependencies"
        if self._is_file(subject):
            edges = self.edges if "projected_from" in self.edges.columns else self.edges.withColumn("projected_from", F.lit(""))
            own = self.spark.createDataFrame([(subject,)], "subject string")
            return traverse.file_dependencies(self.nodes, edges, own, r.limit, reverse).select("position", "id", "relation")
        return traverse.dependencies(self.edges, subject, r.limit, reverse)

    def impacted(self, subject: str) -> DataFrame:
        """Q7: (id, hops) of what has a path to ``subject``. Between two files only file dependencies make one, as in ``path``."""
        if self.labels is not None and not self._is_file(subject):
            return reach_index.all_from(self.labels, self.spark.createDataFrame([(subject,)], "subject string"), reverse=True).select("id", "hops")
        found = traverse.impact(self.edges, subject)
        if not self._is_file(subject):
            return found
        files = self.nodes.where("kind = 'file'").select("id")
        return found.join(files, "id", "left_anti").select("id", "hops").unionByName(traverse.impact(self.file_edges(), subject).select("id", "hops"))

    def index(self) -> DataFrame:
        """Makes the distance index of the edges, and uses it from now on."""
        self.labels = scratch(reach_index.distance_labels(self.edges), "labels")
        return self.labels

    def impact_lines(self, ref: str, limit: int = 20) -> DataFrame:
        """Q7 with the path of each node: (id, hops, line), the nodes in the order of the graph. Between files only file dependencies make a path."""
        subject = self.resolve(ref)
        found = traverse.impact_paths(self.edges, subject)
        if self._is_file(subject):
            files = self.nodes.where("kind = 'file'").select("id")
            found = found.join(files, "id", "left_anti").select("id", "hops", "path").unionByName(traverse.impact_paths(self.file_edges(), subject).select("id", "hops", "path"))
        first = found.join(self.nodes.select("id", "ord"), "id").orderBy("ord", "id").limit(limit)
        names = self.nodes.select("id", described(F.col("label"), F.col("id"), node_layer(F.col("layer"), F.col("id"), F.col("kind"), F.col("source_name"), F.col("source_type")), F.col("kind")).alias("name"))
        steps = first.select(F.col("id").alias("of"), "hops", "ord", F.posexplode("path").alias("step", "id")).join(names, "id", "left").withColumn("name", F.coalesce("name", "id"))
        told = steps.groupBy("of", "hops", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "name"))), lambda x: x["name"]).alias("names"))
        line = F.concat(F.col("names")[0], F.lit(" by way of "), F.array_join("names", " > "))
        return told.orderBy("ord", "of").select(F.col("of").alias("id"), "hops", line.alias("line"))

    def no_path(self, source: str, target: str) -> str:
        """Q8: why no path leads from one node to the other; empty if one does."""
        a, b = self.resolve(source), self.resolve(target)
        if self.labels is not None:
            state = reach_index.verdict(self.labels, a, b)
        else:
            there = [self.edges.where((F.col("src") == x) | (F.col("dst") == x)).isEmpty() for x in (a, b)]
            ways = lambda x, y: not traverse.shortest_path(self.edges, x, y).isEmpty()
            state = "unknown source" if there[0] else "unknown target" if there[1] else "path" if ways(a, b) else "reversed" if ways(b, a) else "apart"
        return {"path": "", "unknown source": f"{source!r} has no edge", "unknown target": f"{target!r} has no edge", "reversed": f"only {target!r} leads to {source!r}"}.get(state, "neither leads to the other")

    def find(self, term: str) -> str | None:
        """The node of that id, label or lowered label, else the best of the lexical search; None without one."""
        if not term:
            return None
        row = graph.resolve_one(self.nodes, self._ref(term)).first() or lookup.search(self.nodes, term, 1).first()
        return row.id if row else None

    def search(self, question: str) -> DataFrame:
        return self.run(parse_question(question))

    def path(self, source: str, target: str) -> DataFrame:
        """Q8, Q9: between two files over file dependencies, ranked; else the shortest path."""
        if self._is_file(source) and self._is_file(target):
            return traverse.ranked_file_path(self.nodes, self.file_edges(), source, target)
        if self.labels is not None:
            return reach_index.path(self.labels, self.edges, source, target)
        return traverse.shortest_path(self.edges, source, target)

    def explain(self, ref: str) -> DataFrame:
        """Q14: every edge at a node that ``ref`` means, as (src, relation, dst, line), each line once."""
        ids = graph.resolve_all(self.nodes, self._ref(ref)).select("id").distinct()
        if ids.isEmpty():
            raise NotFound(f"node {ref!r} not found")
        e = self.edges
        hit = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(*e.columns).unionByName(e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*e.columns)).distinct()
        names = self.nodes.select("id", described(F.col("label"), F.col("id"), node_layer(F.col("layer"), F.col("id"), F.col("kind"), F.col("source_name"), F.col("source_type")), F.col("kind")).alias("name"))
        hit = hit.join(names.withColumnsRenamed({"id": "src", "name": "src_name"}), "src", "left").join(names.withColumnsRenamed({"id": "dst", "name": "dst_name"}), "dst", "left")
        get = lambda c: F.col(c) if c in e.columns else F.lit("")
        value = {n: evidence_confidence(get("evidence_confidence"), get("confidence")) if c is None else get(c) for n, c in _EVIDENCE}
        parts = F.array_compact(F.array(*[F.when(text(v) != "", F.concat(F.lit(f"{n}="), v)) for n, v in value.items()]))
        line = F.concat(F.coalesce("src_name", "src"), F.lit(" --["), "relation", F.lit("]--> "), F.coalesce("dst_name", "dst"), F.when(F.size(parts) > 0, F.concat(F.lit(" {"), F.array_join(parts, ", "), F.lit("}"))).otherwise(""))
        return hit.select("src", "relation", "dst", line.alias("line")).distinct().orderBy("src", "relation", "dst", "line")

    def bindings(self, ref: str) -> DataFrame:
        """Q16."""
        ids = graph.resolve_all(self.nodes, self._ref(ref)).select(F.col("id").alias("src")).distinct()
        return self.edges.where(text("binding_state") != "").join(ids, "src", "left_semi").select("src", "relation", "reference_target", "bound_target", "binding_state", "binding_evidence", "binding_suggestions")

    def route(self, question: str, limit: int = 5) -> DataFrame:
        """Q17."""
        import re

        return workspace.select_repos(self.terms, re.findall("[a-z0-9]+", question.lower()), limit)

    def neighbours(self, ref: str) -> DataFrame:
        return analytics.neighbours(self.edges, self.nodes, self.resolve(ref)).orderBy("direction", "label", "id")

    def query(self, line: str) -> DataFrame:
        """Q18: ``help``, ``lookup``, ``nodes``, ``edges``, ``explain``, ``bindings``, ``route`` and ``path`` in words; else a question.

        What is neither gives one row (message) with the verbs.
        """
        verb, _, rest = line.strip().partition(" ")
        rest = rest.strip()
        if verb == "nodes":
            return self.nodes.agg(F.count("*").alias("nodes"))
        if verb == "edges":
            return self.edges.agg(F.count("*").alias("edges"))
        if verb in ("lookup", "explain", "bindings", "route") and rest:
            return {"lookup": lambda x: lookup.lookup(self.nodes, x), "explain": self.explain, "bindings": self.bindings, "route": self.route}[verb](rest)
        try:
            return self.search(line) if verb != "help" else self._message("\n".join(VERBS))
        except NotFound:
            raise
        except ValueError:
            return self._message(f"unknown command {verb!r}; help lists the commands")

    def _message(self, text_: str) -> DataFrame:
        return self.spark.createDataFrame([(text_,)], "message string")


def rendered(title: str, lines: list[str]) -> str:
    """A title and its lines, sorted, or ``(none)``."""
    return "\n".join([title, *(f"  - {x}" for x in sorted(lines))] if lines else [title, "  (none)"])


def join_key(id_: Column) -> Column:
    return canonical_join_key(id_, F.lit(""), F.lit(""))
