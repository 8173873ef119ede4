"""A vault for each organization, and the folders and workspaces that they name (rows H23, H26)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.identity import text
from codeloom.functions.text import safe_path_component
from codeloom.operators.graph import Graph

from .vault import project_folders, write_vault


def _of_code(nodes: DataFrame) -> Column:
    return text("source_type") == "codebase" if "source_type" in nodes.columns else text("layer") != "memory"


def organizations(nodes: DataFrame) -> DataFrame:
    """(organization, folder) of the organizations that own code."""
    folder = F.concat(F.lit("Organizations/"), F.array_join(F.transform(F.filter(F.split("organization", "/"), lambda x: x != ""), safe_path_component), "/"))
    return nodes.where(_of_code(nodes) & (text("organization") != "")).select("organization").distinct().withColumn("folder", folder)


def organization_graph(g: Graph, organization: str) -> Graph:
    """The code of ``organization`` (empty: that of none), everything that is no code, and the edges whose ends both are there."""
    nodes = g.nodes.where(~_of_code(g.nodes) | (text("organization") == organization))
    ids = nodes.select("id").distinct()
    edges = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    labels = nodes.where(text("label") != "").select(F.col("label").alias("id"))
    return Graph(nodes, edges.join(ids.unionByName(labels).distinct().withColumnRenamed("id", "dst"), "dst", "left_semi").select(*g.edges.columns))


def write_vaults(g: Graph, root: str) -> dict[str, int]:
    """Notes by vault folder, the one without an organization at ``root``; a vault without nodes is not written."""
    written = {}
    vaults = [("", root), *((r.organization, os.path.join(root, r.folder)) for r in organizations(g.nodes).orderBy("organization").toLocalIterator())]
    for organization, folder in vaults:
        own = organization_graph(g, organization)
        if not own.nodes.isEmpty():
            written[folder] = write_vault(own, folder)
    return written


def workspaces(nodes: DataFrame) -> DataFrame:
    """(workspace): labels of workspace nodes and the workspaces that observations name."""
    found = nodes.where("kind = 'workspace'").select(F.col("label").alias("workspace"))
    if "workspace" in nodes.columns:
        found = found.unionByName(nodes.where((F.col("kind") == "observation") & (text("workspace") != "")).select("workspace"))
    return found.distinct()


def project_dirs(nodes: DataFrame) -> DataFrame:
    """(folder) of every project's notes."""
    return project_folders(nodes).select("folder").distinct()
