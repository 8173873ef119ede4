"""Status snapshots, freshness and gates (rows A8-A10, A13, A18, H2-H4, F12, X24, P9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.identity import text

from . import analytics
from .graph import Graph


def health(g: Graph) -> DataFrame:
    """A1 in one row: sizes, quality, degrees, communities, modularity and the share of extracted edges."""
    sizes = g.nodes.agg(F.count("*").alias("nodes"))
    extracted = g.edges.agg(F.coalesce(F.count_if(F.col("confidence") == "EXTRACTED") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("extracted_rate"))
    parts = [sizes, analytics.edge_quality(g.nodes, g.edges), analytics.degree_stats(analytics.degrees(g.nodes, g.edges)), analytics.community_stats(g.nodes), analytics.modularity(g.nodes, g.edges), extracted]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # rows of one
    return out


def members(nodes: DataFrame) -> DataFrame:
    """(community, nodes), none if all are in community 0."""
    c = nodes.groupBy(F.coalesce("community", F.lit(0)).alias("community")).agg(F.count("*").alias("nodes"))
    other = c.agg(F.coalesce(F.max(F.col("community") != 0), F.lit(False)).alias("some"))
    return c.crossJoin(other).where("some").drop("some")


def freshness(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Files, latest change of ``files(path, size, mod_time)``, latest artifact, and whether an artifact is non-empty and no older than every file."""
    f = files.agg(F.count("*").alias("files"), F.max("mod_time").alias("latest_file"))
    a = artifacts.agg(F.max(F.when(F.col("size") > 0, F.col("mod_time"))).alias("latest_artifact"))
    fresh = F.col("latest_artifact").isNotNull() & (F.col("latest_file").isNull() | (F.col("latest_artifact") >= F.col("latest_file")))
    return f.crossJoin(a).withColumn("fresh", fresh)


def gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Each ``limits(metric, least, most)`` against ``metrics(metric, value)``: passed, and by how much it fails; a missing value fails."""
    short = F.greatest(F.coalesce(F.col("least") - F.col("value"), F.lit(0.0)), F.coalesce(F.col("value") - F.col("most"), F.lit(0.0)), F.lit(0.0))
    j = limits.join(metrics, "metric", "left").withColumn("deficit", F.when(F.col("value").isNotNull(), short))
    return j.select("metric", "value", "deficit", (F.coalesce("deficit", F.lit(1.0)) == 0).alias("passed"))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """struct(percentage, estimated_total, estimated_remaining); zeros before anything is done."""
    known = (done > 0) & (total > 0)
    whole = seconds * total / done
    return F.struct(F.when(total > 0, 100.0 * done / total).otherwise(0.0).alias("percentage"), F.when(known, whole).otherwise(0.0).alias("estimated_total"), F.when(known, whole - seconds).otherwise(0.0).alias("estimated_remaining"))


def observation_nodes(notes: DataFrame) -> DataFrame:
    """``notes(number, title, content, workspace, visibility, organization, created_at)`` as observation nodes; dates as yyyy-MM-dd."""
    return notes.select(
        F.concat(F.lit("memory:observation:"), F.col("number").cast("string")).alias("id"), F.col("title").alias("label"), F.lit("observation").alias("kind"), F.lit("").alias("file"), text("content").alias("description"), F.lit("memory").alias("layer"),
        text("workspace").alias("workspace"), text("visibility").alias("visibility"), text("organization").alias("organization"), F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("")).alias("created_at"), F.col("number").cast("long").alias("ord"),
    )


def inside(path: Column, root: str) -> Column:
    """Whether a clean absolute path is ``root`` or below it."""
    base = root.rstrip("/")
    return ((path == base) | path.startswith(base + "/")) & ~path.rlike(r"(^|/)\.\.(/|$)")
