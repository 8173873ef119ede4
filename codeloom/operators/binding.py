"""Historical references bound to live nodes (rows B1-B8), and references in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.identity import text
from codeloom.functions.text import base_name, shared_suffix

FILE, SYMBOL, REPO = "repo:file:", "repo:symbol:", "workspace:repo:"

# Reference patterns, each with its kind, in the order of the result.
PATTERNS = [
    ("file", r'(?:^|[\s(\["])([a-zA-Z0-9_.\-]+(?:/[a-zA-Z0-9_.\-]+)+\.[a-zA-Z]{1,6})'),
    ("function", r"`([A-Z][a-zA-Z0-9_]+(?:[.][A-Z][a-zA-Z0-9_]+)*)`"),
    ("concept", r"\[\[([^\[\]]+)\]\]"),
    ("observation", r"(?:^|[\s,])(?:#|obs:)(\d+)"),
]


# The evidence that a binding carries; results hold these sentences.
EVIDENCE = {
    "file": ["empty file reference", "exact file path match", "no live file candidate matched the historical path", "unique basename match", "best unique path-suffix match", "multiple live files share the historical basename"],
    "symbol": ["empty symbol reference", "no live symbol label matched the historical reference", "unique symbol label match", "multiple live symbols share the historical label"],
    "repo": ["empty workspace repo reference", "workspace repo no longer exists in the live graph", "exact workspace repo match", "multiple workspace repos matched the historical reference"],
    "other": ["memory-internal reference"],
}


def references(title: Column, content: Column) -> Column:
    """Array of struct(kind, target), distinct, by kind and then place."""
    t = F.concat_ws("\n", text(title), text(content))

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("target")))

    found = [of(k, p) for k, p in PATTERNS]
    return F.array_distinct(F.filter(F.concat(*found), lambda r: r["target"] != ""))


def bindings(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, state, bound_target, suggestions, evidence) of each ``targets(target)``.

    Files bind by exact lowered path (the last such file), else a unique base name, else the best shared path suffix of more
    than one segment. Symbols and repositories bind by a unique lowered label. Grouped counts and top-2 structs per target:
    candidates of one base name never meet each other.
    """
    t = targets.select("target").distinct()
    ref = lambda p: F.trim(F.substr("target", F.lit(len(p) + 1)))
    files = nodes.where("kind = 'file'").select("id", F.lower(F.trim("file")).alias("path"), "file", "ord").where("path <> ''")

    f = t.where(F.col("target").startswith(FILE)).withColumn("ref", ref(FILE)).withColumn("low", F.lower("ref"))
    exact = files.groupBy("path").agg(F.max_by("id", F.struct("ord", "id")).alias("exact"))
    by_base = files.withColumn("base", base_name(F.col("path"))).select("base", "id", F.col("file").alias("live"))
    f = f.join(exact, f["low"] == exact["path"], "left").withColumn("base", base_name(F.col("low")))
    c = f.where("exact is null and ref <> ''").select("target", "ref", "base").join(by_base, "base")
    c = c.groupBy("target", "id").agg(F.max(shared_suffix(F.col("ref"), F.col("live"))).alias("score"))
    tied = c.groupBy("target", "score").agg(F.count("*").alias("k"), F.min("id").alias("least"), F.collect_list("id").alias("ids"))
    c = tied.groupBy("target").agg(F.sum("k").alias("n"), F.max(F.struct("score", "k", "least")).alias("b"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    f = f.join(c.select("target", "n", "ids", F.col("b.score").alias("top"), F.col("b.k").alias("n_top"), F.col("b.least").alias("best")), "target", "left")
    unique = (F.col("top") > 1) & (F.col("n_top") == 1)
    no, said = F.lit(None).cast("string"), EVIDENCE["file"]
    files_bound = f.select(
        "target",
        F.when(F.col("ref") == "", "stale").when(F.col("exact").isNotNull(), "current").when(F.col("n").isNull(), "stale").when((F.col("n") == 1) | unique, "redirected").otherwise("ambiguous").alias("state"),
        F.when(F.col("exact").isNotNull(), F.col("exact")).when((F.col("n") == 1) | unique, F.col("best")).otherwise(no).alias("bound_target"),
        F.when(F.col("exact").isNull() & (F.col("n") > 1) & ~unique, F.col("ids")).alias("suggestions"),
        F.when(F.col("ref") == "", said[0]).when(F.col("exact").isNotNull(), said[1]).when(F.col("n").isNull(), said[2]).when(F.col("n") == 1, said[3]).when(unique, said[4]).otherwise(said[5]).alias("evidence"),
    )

    def labelled(prefix: str, live: DataFrame, empty: str, none: str, one: str, many: str) -> DataFrame:
        own = t.where(F.col("target").startswith(prefix)).withColumn("ref", F.lower(ref(prefix)))
        # ids of one label: a list as long as the ambiguity that the reference asks to report
        k = live.groupBy("key").agg(F.countDistinct("id").alias("n"), F.array_sort(F.collect_set("id")).alias("ids"))
        j = own.join(k, own["ref"] == k["key"], "left")
        state = F.when((F.col("ref") == "") | F.col("n").isNull(), "stale").when(F.col("n") == 1, "current").otherwise("ambiguous")
        evidence = F.when(F.col("ref") == "", empty).when(F.col("n").isNull(), none).when(F.col("n") == 1, one).otherwise(many)
        return j.select("target", state.alias("state"), F.when(F.col("n") == 1, F.col("ids")[0]).alias("bound_target"), F.when(F.col("n") > 1, F.col("ids")).alias("suggestions"), evidence.alias("evidence"))

    live_symbols = nodes.where(~F.col("kind").isin("file", "project", "repo") & (text("label") != "")).select("id", F.lower(F.trim("label")).alias("key"))
    symbols = labelled(SYMBOL, live_symbols, *EVIDENCE["symbol"])
    live_repos = nodes.where("kind in ('repo', 'project')").select("id", F.lower(F.trim("label")).alias("key"))
    repos = labelled(REPO, live_repos, *EVIDENCE["repo"])
    other = t.where(~(F.col("target").startswith(FILE) | F.col("target").startswith(SYMBOL) | F.col("target").startswith(REPO)))
    rest = other.select("target", F.lit("current").alias("state"), F.col("target").alias("bound_target"), F.lit(None).cast("array<string>").alias("suggestions"), F.lit(EVIDENCE["other"][0]).alias("evidence"))
    return files_bound.unionByName(symbols).unionByName(repos).unionByName(rest)


def bind_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Memory-reference edges with their binding; dst changes only where the state is current or redirected."""
    ref = F.when((F.col("layer") == "memory") & (F.col("evidence_type") == "reference"), F.coalesce(F.nullif(F.trim(text("reference_target")), F.lit("")), F.trim(text("dst"))))
    e = edges.withColumn("target", ref)
    bound = bindings(e.where("target is not null").select("target"), nodes)
    j = e.join(bound, "target", "left")
    moved = F.col("state").isin("current", "redirected")
    return j.select(*[F.when(moved, F.col("bound_target")).otherwise(F.col("dst")).alias("dst") if c == "dst" else F.col(c) for c in edges.columns if c != "reference_target"], F.col("target").alias("reference_target"), F.col("state").alias("binding_state"), "bound_target", F.col("suggestions").alias("binding_suggestions"), F.col("evidence").alias("binding_evidence"))
