"""Workspace layer and repository routing (rows W1-W7). Terms are rows: (repo_key, repo, term_kind, term)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.identity import text, workspace_node_id
from codeloom.functions.text import route_tokens
from codeloom.session import dealt, numbered, scratch

# Relation and weight of each kind of term.
RELATIONS = {"service": "exposes", "package": "hosts", "domain": "owns", "dependency": "depends_on"}
WEIGHTS = {"name": 3.0, "service": 2.5, "domain": 1.5, "package": 1.0, "dependency": 0.5}
REASONS = {"dependency": "depends_on"}


def repositories(nodes: DataFrame) -> DataFrame:
    """(project_id, repo_key, repo): project nodes by display name (source name, label, id suffix), the first of each lowered name."""
    display = F.coalesce(*[F.nullif(F.trim(text(c)), F.lit("")) for c in ("source_name", "label")], F.nullif(F.regexp_replace("id", "^project:", ""), F.lit("")))
    p = nodes.where("kind = 'project'").select(F.col("id").alias("project_id"), display.alias("repo"), "ord").where("repo is not null")
    first = p.groupBy(F.lower("repo").alias("repo_key")).agg(F.min(F.struct("ord", "project_id", "repo")).alias("f"))
    return first.select("f.project_id", "repo_key", "f.repo")


def repo_terms(nodes: DataFrame, edges: DataFrame, overrides: DataFrame) -> DataFrame:
    """The terms of each repository, once for each lowered term.

    Services: contract services that a ``declared_in`` edge binds to the project. ``overrides(repo, term_kind, term)`` give
    domains, packages and dependencies of known repositories only.
    """
    repos = repositories(nodes)
    name = F.coalesce(F.nullif(F.trim(text("label")), F.lit("")), F.regexp_replace("id", "^contract:service:", ""))
    services = nodes.where("kind = 'service' and startswith(id, 'contract:service:')").select(F.col("id").alias("src"), name.alias("term"))
    bound = edges.where("relation = 'declared_in'").select("src", F.col("dst").alias("project_id")).join(services, "src").join(repos, "project_id").select("repo_key", "repo", F.lit("service").alias("term_kind"), "term")
    given = overrides.select(F.lower("repo").alias("repo_key"), "term_kind", F.trim("term").alias("term")).where("term <> ''").join(repos.select("repo_key", "repo"), "repo_key").select("repo_key", "repo", "term_kind", "term")
    named = repos.select("repo_key", "repo", F.lit("name").alias("term_kind"), F.col("repo").alias("term"))
    every = bound.unionByName(given).unionByName(named)
    return every.groupBy("repo_key", "repo", "term_kind", F.lower("term").alias("k")).agg(F.min("term").alias("term")).drop("k")


def materialized(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Workspace nodes and edges; shared nodes once, dependencies on unknown repositories dropped."""
    repos = terms.where("term_kind = 'name'").select("repo_key", "repo")
    nodes = repos.select(workspace_node_id("repo", F.col("repo")).alias("id"), F.col("repo").alias("label"), F.lit("repo").alias("kind"))
    edges = None
    for kind, relation in RELATIONS.items():
        own = terms.where(F.col("term_kind") == kind)
        if kind == "dependency":
            target = repos.select(F.col("repo_key").alias("__k"), F.col("repo").alias("__r"))
            own = own.join(target, F.lower("term") == F.col("__k")).withColumn("term", F.col("__r"))
        else:
            nodes = nodes.unionByName(own.groupBy(workspace_node_id(kind, F.col("term")).alias("id")).agg(F.min(F.struct("repo_key", "term")).alias("f")).select("id", F.col("f.term").alias("label"), F.lit(kind).alias("kind")))
        to = workspace_node_id("repo" if kind == "dependency" else kind, F.col("term"))
        part = own.select(workspace_node_id("repo", F.col("repo")).alias("src"), to.alias("dst"), F.lit(relation).alias("relation")).distinct()
        edges = part if edges is None else edges.unionByName(part)
    return nodes, edges


def loaded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Terms again from workspace nodes and edges."""
    repos = nodes.where("kind = 'repo' and startswith(id, 'workspace:repo:')").select(F.col("id").alias("src"), F.lower("label").alias("repo_key"), F.col("label").alias("repo"))
    kinds = F.create_map(*[F.lit(x) for k, r in RELATIONS.items() for x in (r, k)])
    held = edges.where(F.col("relation").isin(*RELATIONS.values())).join(repos, "src").join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("term")), "dst")
    held = held.select("repo_key", "repo", kinds[F.col("relation")].alias("term_kind"), "term")
    return held.unionByName(repos.select("repo_key", "repo", F.lit("name").alias("term_kind"), F.col("repo").alias("term"))).distinct()


def exposing(terms: DataFrame, service: str) -> DataFrame:
    """W5."""
    return terms.where((F.col("term_kind") == "service") & (F.lower("term") == service.strip().lower())).select("repo").distinct()


def select_repos(terms: DataFrame, tokens: list[str], limit: int = 5) -> DataFrame:
    """(repo, score, reasons) by score, then key. A token matches the terms it is a substring of; repeated tokens count again.

    The tokens of one question are few; each term is matched against them in place, without a join.
    """
    asked = [t.strip().lower() for t in tokens if t.strip()]
    given = F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")
    hits = F.size(F.filter(given, lambda t: F.contains(F.lower("term"), t)))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("term_kind"))
    reason = F.concat_ws(":", F.when(F.col("term_kind") == "dependency", "depends_on").otherwise(F.col("term_kind")), "term")
    scored = terms.withColumn("hits", hits).where("hits > 0").groupBy("repo_key", "repo").agg(F.sum(weight * F.col("hits")).alias("score"), F.array_sort(F.collect_set(reason)).alias("reasons"))
    return scored.orderBy(F.desc("score"), "repo_key").limit(limit).select("repo", "score", "reasons")


#: Questions of one task, each of which may score every repository.
QUESTIONS = 1 << 14

#: Tokens of one automaton; more are looked for in turns.
TOKENS = 200_000


def tokens_in(terms: DataFrame, tokens: DataFrame, most: int = TOKENS) -> DataFrame:
    """(term, token) of every lowered term of ``terms(term)`` and token of ``tokens(token)`` that is a part of it.

    The distinct tokens become an Aho-Corasick automaton, ``most`` at a time; each task builds it once and runs it over its
    terms, each of which is read once however many tokens there are. No pair is formed that does not match.
    """
    spark = terms.sparkSession
    listed = numbered(tokens.select("token").where("token <> ''").distinct(), ["token"], "n")
    words = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    out = None
    for low in range(0, listed.count(), most):
        part = spark.sparkContext.broadcast([r.token for r in listed.where((F.col("n") >= low) & (F.col("n") < low + most)).select("token").collect()])

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for t in part.value:
                machine.add_word(t, t)
            machine.make_automaton()
            for b in batches:
                found = [(w, t) for w in b.column("term").to_pylist() for t in {t for _, t in machine.iter(w)}]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], names=["term", "token"])

        met = words.mapInArrow(run, "term string, token string")
        out = met if out is None else out.unionByName(met)
    return out if out is not None else spark.createDataFrame([], "term string, token string")


def route_all(terms: DataFrame, questions: DataFrame, limit: int = 5) -> DataFrame:
    """Q17, W4 for a table: (question_id, rank, repo, score), the ``limit`` best repositories of every ``questions(question_id, question)`` in one job.

    As ``select_repos``: a token scores once for each time it is asked and each term that it is a part of. Questions are dealt
    by id before their tokens meet the repositories: what is shuffled is the question, not a row for each repository it may mean.
    """
    tokens = lambda q: q.select("question_id", F.explode(route_tokens(F.col("question"))).alias("token"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("term_kind"))
    # what a token adds to a repository is summed before the questions are met
    worth = tokens_in(terms, tokens(questions)).join(terms.select("repo_key", "repo", F.lower("term").alias("term"), weight.alias("w")), "term")
    worth = scratch(worth.groupBy("token", "repo_key", "repo").agg(F.sum("w").alias("w")), "worth")
    own = dealt(questions.select("question_id", "question"), questions.count(), "question_id", most=QUESTIONS)
    scored = tokens(own).join(worth, "token").groupBy("question_id", "repo_key", "repo").agg(F.sum("w").alias("score"))
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "repo_key")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("question_id", "rank", "repo", "score")
