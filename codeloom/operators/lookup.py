"""Lexical lookup (rows L1-L8): scores are expressions on a node's columns; the best are a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import path_suffix


def _low(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def lookup_score(term: Column, tokens: Column) -> Column:
    """L2: ``term`` is lowered and trimmed, ``tokens`` its lookup tokens."""
    label, id_, file, description = (_low(c) for c in ("label", "id", "file", "description"))
    whole = (
        F.when((label == term) | (id_ == term), 100)
        .when(file == term, 95)
        .when((path_suffix(file) == path_suffix(term)) & (path_suffix(term) != ""), 85)
        .when(label.contains(term), 70)
        .when(file.contains(term), 65)
        .when(id_.contains(term), 60)
        .otherwise(0)
    )

    def points(t: Column) -> Column:
        return F.when(label.contains(t), 18).when(file.contains(t), 16).when(id_.contains(t), 14).when(description.contains(t), 6).otherwise(0)

    each = F.transform(tokens, points)
    matched = F.size(F.filter(each, lambda p: p > 0))
    path_like = term.contains("/") | term.contains(".")
    kind = F.when(F.col("kind") == "file", F.when(path_like, 12).otherwise(0)).otherwise(F.when(path_like, 0).otherwise(8))
    tests = F.when(file.contains("/test") | file.contains(".test.") | file.contains("_test."), -10).otherwise(0)
    every = F.when((matched == F.size(tokens)) & (F.size(tokens) > 1), 20).otherwise(0)
    return F.when(matched == 0, 0).otherwise(whole + F.aggregate(each, F.lit(0), lambda a, p: a + p) + every + kind + tests)


def lookup(nodes: DataFrame, term: str, limit: int = 5) -> DataFrame:
    """L1: (id, label, kind, score) by score, label, id."""
    from codeloom.functions.text import lookup_tokens

    t = F.lit(term.strip().lower())
    scored = nodes.select("id", "label", "kind", lookup_score(t, lookup_tokens(t)).alias("score")).where("score <> 0")
    return scored.orderBy(F.desc("score"), "label", "id").limit(limit)


def search_score(term: Column) -> Column:
    """L7."""
    label, id_, file, description = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("label", "id", "file", "description"))
    whole = F.when((label == term) | (id_ == term), 10).when(label.contains(term), 6).when(id_.contains(term), 5).otherwise(0)
    return whole + F.when(file.contains(term), 3).otherwise(0) + F.when(description.contains(term), 2).otherwise(0)


def search(nodes: DataFrame, term: str, limit: int = 5) -> DataFrame:
    """By score, label, id."""
    t = term.strip().lower()
    scored = nodes.select("id", "label", "kind", search_score(F.lit(t)).alias("score")).where("score <> 0" if t else "false")
    return scored.orderBy(F.desc("score"), "label", "id").limit(limit)


def ndcg(hits: DataFrame, grades: DataFrame, k: int = 5) -> DataFrame:
    """Recall and nDCG at ``k`` of ``hits(case, position, label)`` against ``grades(case, label, grade)``, per case."""
    gain = lambda g, at: g / F.log2(at + 1)
    got = hits.where(F.col("position") <= k).join(grades, ["case", "label"]).groupBy("case").agg(F.count("*").alias("found"), F.sum(gain(F.col("grade"), F.col("position"))).alias("dcg"))
    from pyspark.sql import Window

    ideal = grades.withColumn("at", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("grade"), "label")))
    ideal = ideal.groupBy("case").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("at") <= k, gain(F.col("grade"), F.col("at")))).alias("ideal"))
    j = ideal.join(got, "case", "left").na.fill(0)
    return j.select("case", F.round(F.col("found") / F.col("relevant"), 6).alias("recall"), F.round(F.col("dcg") / F.col("ideal"), 6).alias("ndcg"))
