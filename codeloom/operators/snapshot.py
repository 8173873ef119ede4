"""Status of one repository and of many, hooks and ranked shortfalls (rows A10, A18, H11)."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import analytics, status
from .graph import Graph

HOOKS = ("post-commit", "post-checkout")


@dataclass(frozen=True)
class Snapshot:
    """A10: what a status view shows of one graph."""

    metrics: DataFrame
    freshness: DataFrame
    projects: DataFrame
    members: DataFrame
    hooks: str


def hook_state(root: str, mark: str = "codeloom") -> str:
    """``installed`` if both hooks of the repository name ``mark``, ``partial`` if one does, ``missing``, or ``path unavailable``."""
    if not root.strip() or not os.path.isdir(root):
        return "path unavailable"

    def set_up(name: str) -> bool:
        try:
            with open(os.path.join(root, ".git", "hooks", name), encoding="utf-8", errors="replace") as f:
                return mark in f.read()
        except OSError:
            return False

    n = sum(map(set_up, HOOKS))
    return ("missing", "partial", "installed")[n]


def snapshot(g: Graph, files: DataFrame, artifacts: DataFrame, root: str = "") -> Snapshot:
    """A10: metrics, freshness, projects and communities of a built graph; see ``status`` and ``analytics`` for each."""
    return Snapshot(status.health(g), status.freshness(files, artifacts), analytics.project_status(g.nodes, g.edges), status.members(g.nodes), hook_state(root))


def shortfalls(gates: DataFrame) -> DataFrame:
    """(rank, metric, value, deficit) of the gates that failed, a missing value first, then the largest deficit; metric decides ties.

    Gates are a short list, so one window over them is fine.
    """
    from pyspark.sql import Window

    order = Window.orderBy(F.desc_nulls_first("deficit"), "metric")
    return gates.where("not passed").select(F.row_number().over(order).alias("rank"), "metric", "value", "deficit")


def compared(metrics: DataFrame, before: DataFrame) -> DataFrame:
    """(metric, before, value, delta, improved, regressed) of two runs; a metric that one of them lacks has null deltas."""
    j = metrics.select("metric", "value").join(before.select("metric", F.col("value").alias("before")), "metric", "full_outer")
    delta = F.col("value") - F.col("before")
    return j.select("metric", "before", "value", delta.alias("delta"), F.coalesce(delta > 0, F.lit(False)).alias("improved"), F.coalesce(delta < 0, F.lit(False)).alias("regressed"))
