"""Ignore rules (rows P1-P7): patterns become regular expressions; a few lists are one expression, rules of many folders a table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that every stack ignores, and those of each stack.
GENERIC = [".git/", ".svn/", ".hg/", ".DS_Store", "Thumbs.db", "*.log", "*.lock", "coverage/", ".nyc_output/", ".cache/", "*.tmp", "*.temp"]
BY_STACK = {
    "node": ["node_modules/", "dist/", "build/", "out/", ".next/", ".nuxt/", ".svelte-kit/", ".turbo/", ".vercel/", ".netlify/", ".angular/", "*.d.ts", "*.js.map", "*.chunk.js", "storybook-static/"],
    "go": ["vendor/", "bin/", "*.test"],
    "python": ["__pycache__/", "*.pyc", "*.pyo", "*.pyd", ".venv/", "venv/", "env/", ".env/", "*.egg-info/", "dist/", "build/", "*.dist-info/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/", "htmlcov/", "site/"],
    "rust": ["target/"],
    "java": ["target/", "build/", ".gradle/", "out/", "*.class", "*.jar", "*.war", "*.ear"],
}
# Files that tell a stack, in order of priority.
PROBES = [("package.json", "node"), ("go.mod", "go"), ("Cargo.toml", "rust"), ("pom.xml", "java"), ("build.gradle", "java"), ("build.gradle.kts", "java"), ("pyproject.toml", "python"), ("setup.py", "python"), ("requirements.txt", "python")]


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    directory: bool


def _segment(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            out += "[" + glob[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


#: A line as (not?, pattern, folders only?); a backslash in front takes the meaning from what follows.
_LINE = re.compile(r"(?P<brings_back>!)?\\?(?P<glob>.*?)(?P<folder>/)?", re.DOTALL)


def parsed(line: str) -> Rule | None:
    """A rule of one line; blank lines and comments are none. A rule without an inner slash matches at any depth."""
    found = re.fullmatch(r"(?!#)(.+?)[ \t]*", line, re.DOTALL)
    if not found or not found[1].strip(" \t"):
        return None
    rule = _LINE.fullmatch(found[1])
    segments = rule["glob"].removeprefix("/").split("/")
    anchored = "/" in rule["glob"]
    body = ""
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "**":
            body += "(?:.*)?" if last else "(?:[^/]+/)*"
        else:
            following = segments[i + 1 :]
            open_end = bool(following) and all(x == "**" for x in following)
            body += _segment(s) + ("" if last else "(?:/.*)?" if open_end else "/")
            if open_end:
                break
    return Rule(("^" if anchored else "^(?:.*/)?") + body + "$", bool(rule["brings_back"]), bool(rule["folder"]))


def rules(lines: list[str]) -> list[Rule]:
    return [r for r in map(parsed, lines) if r]


def default_rules(stack: str) -> list[Rule]:
    """P6."""
    return rules(GENERIC + BY_STACK.get(stack, []))


def ignored(path: Column, is_dir: Column, own: list[Rule]) -> Column:
    """The last rule that matches decides; a path outside the root is not ignored."""
    decision = F.lit(False)
    for r in own:
        hit = path.rlike(r.regex)
        if r.directory:
            hit = hit & is_dir
        decision = F.when(hit, F.lit(not r.negated)).otherwise(decision)
    return F.when(path.startswith(".."), F.lit(False)).otherwise(decision)


def ignored_with_parents(path: Column, lists: list[list[Rule]]) -> Column:
    """A file is out if any list ignores it or one of its directories. No list brings back what another has left out."""
    parts = F.split(path, "/")
    n = F.size(parts)
    above = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))

    def by(own: list[Rule]) -> Column:
        return ignored(path, F.lit(False), own) | F.exists(above, lambda d: ignored(d, F.lit(True), own))

    out = F.lit(False)
    for own in lists:
        out = out | by(own)
    return out


RULES = "folder string, list int, ordinal int, regex string, negated boolean, directory boolean"


def rule_rows(folder: str, lists: list[list[Rule]]) -> list[tuple]:
    """The rows of a rule table for the lists of a folder ("" is the root)."""
    return [(folder, k, i, r.regex, r.negated, r.directory) for k, own in enumerate(lists) for i, r in enumerate(own)]


def with_folders(paths: DataFrame) -> DataFrame:
    """(path, part, is_dir): each path and every folder above it."""
    parts = F.split("path", "/")
    return paths.where("path <> ''").select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k")).select("path", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "/").alias("part"), (F.col("k") < F.size(parts)).alias("is_dir"))


def ignored_paths(paths: DataFrame, table: DataFrame) -> DataFrame:
    """(path) of ``paths(path)`` that the lists of a rule table leave out.

    Paths and their folders, each once, meet the rules of the folders above them by an equi-join; of the rules of a list that match
    what lies below its folder, the last decides. A path goes if a list leaves out the path or a folder of it. The plan does not
    grow with the folders or rules. Only folders that have rules are kept before the join.
    """
    every = with_folders(paths)
    things = every.select("part", "is_dir").distinct()
    parts = F.split("part", "/")
    above = things.select("part", "is_dir", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("k")).select("part", "is_dir", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "/").alias("folder"))
    below = F.when(F.col("folder") == "", F.col("part")).otherwise(F.substr("part", F.length("folder") + 2))
    met = above.join(table, "folder").where((F.col("is_dir") | ~F.col("directory")) & F.rlike(below, F.col("regex")))
    last = met.groupBy("part", "is_dir", "folder", "list").agg(F.max_by("negated", "ordinal").alias("negated"))
    out = last.where(~F.col("negated")).select("part", "is_dir").distinct()
    return every.join(out, ["part", "is_dir"], "left_semi").select("path").distinct()


def detect_stack(paths):
    """(directory, stack): the stack of each directory by the first probe file that it has."""
    probe = F.create_map(*[F.lit(x) for i, (name, stack) in enumerate(PROBES) for x in (name, f"{i:02d}:{stack}")])
    base, folder = F.substring_index("path", "/", -1), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return paths.select(folder.alias("directory"), probe[base].alias("p")).where("p is not null").groupBy("directory").agg(F.substr(F.min("p"), F.lit(4)).alias("stack"))
