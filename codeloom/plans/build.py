"""The write path (rows S11, S12, S16, S17, S19, R11, R12, R19, T5, U1-U5, H3, H19-H22): files to a persisted graph.

Stages in order: detect, scan, drivers, patch, merge, build, cluster, persist. Every stage can be replaced; a driver or the
clustering that fails leaves a warning and no more. Several repositories are built one graph each and united.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import is_code_file
from codeloom.operators import community, manifest, modularity
from codeloom.operators.graph import Graph, file_projection, merge_facts, pruned
from codeloom.operators.ignore import PROBES
from codeloom.session import scratch
from codeloom.sources.extract import extracted, go_module, parsed
from codeloom.sources.repo_scan import scan

from .reuse import NEWER, Saved, fingerprint, refusal

STAGES = ("detect", "scan", "drivers", "patch", "merge", "build", "cluster", "persist")
# Files that tell a language of a repository.
LANGUAGE_FILES = {"go.mod": "go", "tsconfig.json": "typescript", "package.json": "javascript", "pyproject.toml": "python", "requirements.txt": "python", "setup.py": "python", "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java"}
FACTS = "from_id string, to_id string, kind string, provenance array<struct<source:string,driver:string,confidence:string,artifact:string>>, ord long"


@dataclass(frozen=True)
class BuildRequest:
    """Blank and repeated names are dropped, the rest sorted; no stages means all."""

    root: str
    languages: tuple[str, ...] = ()
    drivers: tuple[str, ...] = ()
    patchers: tuple[str, ...] = ()
    stages: tuple[str, ...] = ()

    def normalized(self) -> BuildRequest:
        clean = lambda xs: tuple(sorted({x.strip() for x in xs if x.strip()}))
        stages = tuple(s for s in STAGES if s in self.stages) or STAGES
        return BuildRequest(self.root.rstrip("/"), clean(self.languages), clean(self.drivers), clean(self.patchers), stages)


@dataclass(frozen=True)
class Driver:
    """A source of facts for some languages."""

    name: str
    languages: tuple[str, ...]
    facts: Callable[[SparkSession, BuildRequest], DataFrame]
    supports: Callable[[str], bool] = lambda root: True


def picked(drivers: list[Driver], request: BuildRequest, languages: list[str]) -> list[Driver]:
    """Drivers of a wanted language, on the allow-list if there is one, that support the root; by name."""
    wanted = set(request.languages or languages)
    return sorted((d for d in drivers if wanted & set(d.languages) and (not request.drivers or d.name in request.drivers) and d.supports(request.root)), key=lambda d: d.name)


def languages_of(files: DataFrame) -> list[str]:
    """Languages told by the names of files; a handful of rows."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_FILES.items() for x in kv])
    return sorted(r[0] for r in files.select(table[F.substring_index("path", "/", -1)].alias("l")).where("l is not null").distinct().collect())


def stack_of(root: str) -> str:
    """S18 for a local folder."""
    return next((stack for name, stack in PROBES if os.path.exists(os.path.join(root, name))), "unknown")


def is_repository(root: str) -> bool:
    return os.path.exists(os.path.join(root, ".git"))


def child_repositories(root: str) -> list[str]:
    """Repositories under ``root``, not those inside another one."""
    found = []
    for folder, names, _ in os.walk(root):
        if folder != root and is_repository(folder):
            found.append(folder)
            names[:] = []
        names[:] = sorted(n for n in names if n != ".git")
    return sorted(found)


def identity_of(root: str) -> tuple[str, str]:
    """(id, name) of a repository from its git remote, else from its folder."""
    try:
        remote = subprocess.run(["git", "-C", root, "remote", "get-url", "origin"], capture_output=True, text=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        remote = ""
    name = os.path.basename(os.path.abspath(root))
    if not remote:
        return name, name
    plain = remote.removesuffix(".git")
    if "://" in plain:
        plain = plain.split("://", 1)[1].split("@")[-1]
        host, _, path = plain.partition("/")
    else:
        host, _, path = plain.split("@")[-1].partition(":")
    path = path.strip("/")
    return (f"{host.split(':')[0]}/{path}", path.rsplit("/", 1)[-1]) if path else (name, name)


def find_graph(start: str, name: str = "graph.json", folder: str = ".codeloom") -> str | None:
    """The document in the folder's own output, then in those of the folders above."""
    at = os.path.abspath(start)
    while True:
        for path in (os.path.join(at, folder, name), os.path.join(at, name)):
            if os.path.exists(path):
                return path
        above = os.path.dirname(at)
        if above == at:
            return None
        at = above


@dataclass
class Result:
    graph: Graph
    manifest: DataFrame
    mode: str = "full_rebuild"
    refused: str = ""
    warnings: list[str] = field(default_factory=list)
    stages: list[tuple[str, str]] = field(default_factory=list)
    #: What the extractors read in each code file; None with another scanner.
    rows: DataFrame | None = None


@dataclass
class Builder:
    """The hooks of a build."""

    spark: SparkSession
    drivers: list[Driver] = field(default_factory=list)
    patchers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    detect: Callable[[SparkSession, str], DataFrame] | None = None
    scanner: Callable[[DataFrame, str, str, str], Graph] = extracted
    cluster: Callable[[Graph], DataFrame] | None = None
    persist: Callable[[Result], None] | None = None
    observer: Callable[[str, str], None] = lambda stage, state: None

    def run(self, request: BuildRequest, saved: Saved | tuple[Graph, DataFrame] | None = None) -> Result:
        """``saved``: the last build, or a graph and manifest just made. Unchanged files return it; deletions alone prune it; else only new and
        changed files are parsed, if it is known what was read in the others, and the graph is put together again (``changed_files``).

        ``reuse.refusal`` lists what keeps a saved build from being used.
        """
        r = request.normalized()
        if unknown := [p for p in r.patchers if p not in self.patchers]:
            raise ValueError(f"unknown patcher {unknown[0]!r}")
        every = self.detect(self.spark, r.root) if self.detect else scan(self.spark, r.root, stack_of(r.root))
        files = every.where(is_code_file(F.col("path")) | F.col("path").rlike(r"(^|/)package\.json$"))
        listing = scratch(manifest.manifest(files.where(is_code_file(F.col("path")))), "manifest")
        out = Result(Graph(*[self.spark.createDataFrame([], "id string")] * 2), listing)
        self._note(out, "detect", "done")
        if isinstance(saved, tuple):
            saved = Saved(*saved, fingerprint=fingerprint())
        out.refused = refusal(saved, bool(r.languages or r.drivers or r.patchers), listing)
        known = saved is not None and saved.rows is not None and self.scanner is extracted
        if not out.refused or known and out.refused == NEWER:
            changes = scratch(manifest.diff(saved.manifest, listing), "changes")
            mode = "none" if out.refused else manifest.reuse_mode(changes).first().mode
            out.refused = ""
            if mode == "unchanged":
                out.graph, out.mode = saved.graph, "reused"
                return out
            if known and mode != "deleted_only":
                out.rows, out.mode = self._changed_rows(files, saved.rows, changes), "changed_files"
            if mode == "deleted_only":
                out.rows = None if saved.rows is None else scratch(saved.rows.join(changes.where("status = 'deleted'"), "path", "left_anti").select(*saved.rows.columns), "rows")
                out.graph, out.mode = pruned(saved.graph, changes.where("status = 'deleted'")), "deleted_only_prune"
                self._persist(out)
                return out
        repo, name = identity_of(r.root)
        if self.scanner is extracted:
            out.rows = out.rows if out.rows is not None else scratch(parsed(files.where(is_code_file(F.col("path")))), "rows")
            g = extracted(files, repo, name, go_module(every), out.rows)
        else:
            g = self.scanner(files, repo, name, go_module(every))
        self._note(out, "scan", "done")
        facts = self._facts(r, out, languages_of(every))
        if facts is not None:
            for p in r.patchers:
                facts = self.patchers[p](facts)
            self._note(out, "patch", "done")
            merged = merge_facts(g, facts)
            stubs = merged.nodes.where("part = 1").select("id", "label", "kind", "ord")
            edges = merged.edges.where("evidence_type is not null").select("src", "dst", "relation", F.lit("EXTRACTED").alias("confidence"), F.lit(0.0).alias("score"), F.lit("").alias("file"), F.lit("").alias("projected_from"), "ord")
            g = Graph(g.nodes.unionByName(stubs, allowMissingColumns=True), g.edges.unionByName(edges, allowMissingColumns=True))
        lifted = file_projection(g)
        known = g.edges.select("src", "dst").where("relation = 'depends_on'")
        extra = lifted.join(known, ["src", "dst"], "left_anti").select("src", "dst", "relation", F.lit("EXTRACTED").alias("confidence"), F.lit(0.0).alias("score"), F.lit("").alias("file"), "projected_from", "ord")
        g = Graph(g.nodes, g.edges.unionByName(extra, allowMissingColumns=True))
        self._note(out, "merge", "done")
        built = g.built()
        out.graph = Graph(scratch(built.nodes, "nodes"), scratch(built.edges, "edges"))
        self._note(out, "build", "done")
        if "cluster" in r.stages:
            self._cluster(out)
        self._persist(out)
        return out

    @staticmethod
    def _changed_rows(files: DataFrame, rows: DataFrame, changes: DataFrame) -> DataFrame:
        """The kept rows of unchanged files, and those parsed in new and changed ones."""
        kept = rows.join(changes.where("status <> 'unchanged'"), "path", "left_anti").select(*rows.columns)
        dirty = changes.where("status in ('new', 'changed')").select("path")
        fresh = parsed(files.where(is_code_file(F.col("path"))).join(dirty, "path", "left_semi"))
        return scratch(kept.unionByName(fresh), "rows")

    def run_all(self, root: str) -> Result:
        """One build for each repository under ``root``, or for it alone; warnings name their repository."""
        roots = [root] if is_repository(root) else child_repositories(root) or [root]
        results = [(x, self.run(BuildRequest(x))) for x in roots]
        g = Graph.union_all([x.graph for _, x in results])
        listings = [x.manifest.withColumn("path", F.concat(F.lit(os.path.relpath(p, root) + "/"), "path")) if len(roots) > 1 else x.manifest for p, x in results]
        return Result(g, reduce(DataFrame.unionByName, listings), warnings=[f"{os.path.basename(p)}: {w}" for p, x in results for w in x.warnings], stages=[s for _, x in results for s in x.stages])

    def _note(self, out: Result, stage: str, state: str) -> None:
        out.stages.append((stage, state))
        self.observer(stage, state)

    def _facts(self, r: BuildRequest, out: Result, languages: list[str]) -> DataFrame | None:
        """The facts of all drivers, earlier ones first."""
        found = None
        for k, d in enumerate(picked(self.drivers, r, languages)):
            try:
                facts = scratch(d.facts(self.spark, r).select("from_id", "to_id", "kind", "provenance", (F.col("ord") + (k << 40)).alias("ord")), "facts")
            except Exception as e:  # noqa: BLE001  a driver that fails does not end the build
                out.warnings.append(f"driver {d.name}: {e}")
                continue
            found = facts if found is None else found.unionByName(facts)
        self._note(out, "drivers", "done")
        return found

    def _cluster(self, out: Result) -> None:
        run = self.cluster or (lambda g: community.numbered(modularity.partition(g.nodes, g.edges)))
        try:
            out.graph = Graph(scratch(community.apply_communities(out.graph.nodes, run(out.graph)), "nodes"), out.graph.edges)
            self._note(out, "cluster", "done")
        except Exception as e:  # noqa: BLE001  a graph without communities is still a graph
            out.warnings.append(f"cluster: {e}")
            self._note(out, "cluster", "failed")

    def _persist(self, out: Result) -> None:
        if self.persist:
            self.persist(out)
            self._note(out, "persist", "done")


def summarized(stages: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """(stage, state, times) in the order of the stages."""
    return [(s, state, n) for s in STAGES for state in sorted({b for a, b in stages if a == s}) if (n := stages.count((s, state)))]
