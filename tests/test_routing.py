"""Routing of many questions by one automaton, and ignore rules from a table, against their one-by-one forms."""

import random

import pytest

from codeloom.operators import ignore, workspace

TERM = "repo_key string, repo string, term_kind string, term string"


@pytest.mark.parametrize("most", [workspace.TOKENS, 3])
def test_route_all(spark, monkeypatch, most):
    monkeypatch.setattr(workspace.tokens_in, "__defaults__", (most,))
    rng = random.Random(5)
    words = ["auth", "Auth.Service", "pay", "payments", "order-api", "user store", "a", ""]
    terms = [(f"r{k % 4}", f"R{k % 4}", rng.choice(["name", "service", "domain", "package", "dependency"]), rng.choice(words)) for k in range(30)]
    asked = {1: "Who does auth and pay? pay!", 2: "", 3: "nothing fits", 4: "ORDER api of a user", 5: None}
    df = spark.createDataFrame(terms, TERM)
    got = workspace.route_all(df, spark.createDataFrame(list(asked.items()), "question_id int, question string"), 3)
    rows = {q: [(r.repo, r.score) for r in sorted(got.where(f"question_id = {q}").collect(), key=lambda r: r.rank)] for q in asked}
    import re

    for q, text in asked.items():
        want = workspace.select_repos(df, re.findall("[a-z0-9]+", (text or "").lower()), 3)
        assert rows[q] == [(r.repo, r.score) for r in want.collect()], q


def test_route_all_deals_questions_once(spark, monkeypatch):
    """Questions are shuffled by id alone, in parts of bounded size; none of the rows by repository is shuffled again. Repeated ids add up."""
    monkeypatch.setattr(workspace, "QUESTIONS", 4)
    terms = spark.createDataFrame([(f"r{k}", f"R{k}", "service", f"pay{k % 3}") for k in range(9)], TERM)
    asked = spark.createDataFrame([(k % 15, f"pay{k % 3} pay") for k in range(20)], "question_id int, question string")
    got = workspace.route_all(terms, asked, 2)
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "REPARTITION_BY_NUM" in plan and not any("Exchange hashpartitioning" in x and "repo_key" in x for x in plan.splitlines())
    rows = {(r.question_id, r["rank"]): (r.repo, r.score) for r in got.collect()}
    # each of the two questions of id 0 asks pay0 and pay
    assert rows[0, 1] == ("R0", 10.0) and rows[14, 1] == ("R2", 5.0) and len(rows) == 30


def test_rule_table(spark):
    rng = random.Random(6)
    names = ["a", "b", "gen", "x.log", "keep.log", "y.ts"]
    paths = sorted({"/".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(80)})
    lists = {"": [["*.log", "!keep.log"], ["/a/gen/"]], "a": [["gen/", "!b/gen/"]], "a/b": [["y.ts", "*.log", "!x.log"]], "gen": [[]]}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    table = spark.createDataFrame([r for folder, own in lists.items() for r in ignore.rule_rows(folder, [ignore.rules(x) for x in own])], ignore.RULES)
    want = set()
    for folder, own in lists.items():
        inside = [p for p in paths if not folder or p.startswith(folder + "/")]
        rel = spark.createDataFrame([(p, p[len(folder) + 1 :] if folder else p) for p in inside] or [("", "")], "whole string, path string")
        if any(own):
            want |= {r.whole for r in rel.where(ignore.ignored_with_parents(rel["path"], [ignore.rules(x) for x in own if x])).collect()}
    assert {r.path for r in ignore.ignored_paths(df, table).collect()} == want - {""}
    assert ignore.ignored_paths(df.limit(0), table).count() == 0
