"""Linked Markdown notes, one for each node (rows K5-K8, A16, H23-H26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.identity import text
from codeloom.functions.text import safe_path_component
from codeloom.operators.graph import Graph

from .staged import write_files


def _known(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(text(c)), F.lit("")) for c in columns])


def project_key() -> Column:
    """Source id, id after ``project:``, id before ``:``, source name."""
    head = F.when(F.col("id").contains(":"), F.substring_index("id", ":", 1))
    return _known(F.col("source_id"), F.when(F.col("kind") == "project", F.regexp_extract("id", "^project:(.*)$", 1)), head, F.col("source_name"))


def _folder(*parts: Column) -> Column:
    every = F.flatten(F.array(*[F.split(p, "/") for p in parts]))
    return F.array_join(F.transform(F.filter(every, lambda x: x != ""), safe_path_component), "/")


def project_folders(nodes: DataFrame) -> DataFrame:
    """(key, folder). An organized project is called by its name; where two would share a folder, by their keys."""
    p = nodes.where("kind = 'project'").select(project_key().alias("key"), _known(F.col("organization")).alias("org"), _known(F.col("source_name"), F.col("label")).alias("name")).where("key is not null").distinct()
    preferred = F.when(F.col("org").isNotNull() & F.col("name").isNotNull(), _folder(F.col("name"))).otherwise(F.concat(F.lit("Projects/"), _folder(F.col("key"))))
    p = p.groupBy("key").agg(F.min(F.struct("org", "name")).alias("p")).select("key", "p.org", "p.name").withColumn("preferred", preferred)
    shared = p.groupBy("preferred").agg(F.count("*").alias("n"))
    return p.join(shared, "preferred").select("key", F.when(F.col("n") == 1, F.col("preferred")).otherwise(F.concat(F.lit("Projects/"), _folder(F.col("key")))).alias("folder"))


def note_paths(nodes: DataFrame) -> DataFrame:
    """(id, path): the note of each node, paths relative to the vault and without an ending."""
    n = nodes.withColumn("key", project_key()).join(project_folders(nodes), "key", "left")
    folder = F.coalesce("folder", F.concat(F.lit("Projects/"), _folder(F.coalesce("key", F.lit("_unknown")))))
    label, flat = safe_path_component(F.col("label")), safe_path_component(F.col("file"))
    index = F.concat(F.lit("Memories/_index/"), safe_path_component(F.concat_ws("-", "kind", "label")))
    symbols = F.when(text("file") == "", F.lit("_symbols")).otherwise(flat)
    path = (
        F.when(F.col("kind") == "memory_source", "Memories/_root")
        .when(F.col("kind").isin("workspace", "visibility", "organization"), index)
        .when(F.col("kind") == "observation", F.concat(F.lit("Memories/_unsorted/_unsorted/"), label))
        .when(F.col("kind") == "project", F.concat(folder, F.lit("/_index")))
        .when(F.col("kind") == "file", F.concat(folder, F.lit("/"), F.when(text("file") == "", label).otherwise(flat)))
        .otherwise(F.concat_ws("/", folder, symbols, label))
    )
    return n.select("id", path.alias("path"))


def notes(g: Graph) -> DataFrame:
    """K5, K6: (path, text) of every note. A link goes to a target by id, or by label to a file, else to another node of that label."""
    paths = note_paths(g.nodes)
    by_label = g.nodes.where(text("label") != "").groupBy(F.col("label").alias("dst")).agg(F.min(F.struct((F.col("kind") != "file").alias("a"), F.col("ord"), F.col("id"))).alias("f")).select("dst", F.col("f.id").alias("by_label"))
    e = g.edges.select("src", "dst").distinct().join(g.nodes.select(F.col("id").alias("dst"), F.lit(True).alias("known")), "dst", "left").join(by_label, "dst", "left")
    e = e.select(F.col("src").alias("id"), F.when(F.col("known"), F.col("dst")).otherwise(F.col("by_label")).alias("to")).where("to is not null and to <> id")
    links = e.join(paths.select(F.col("id").alias("to"), F.col("path").alias("target")), "to").select("id", F.concat(F.lit("- [["), "target", F.lit("]]")).alias("link")).distinct()
    # a note lists its node's links; the list is as long as the note is
    links = links.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("link")), "\n").alias("links"))
    quoted = lambda c: F.to_json(F.array(text(c)))
    value = lambda c: F.regexp_replace(quoted(c), r"(?s)^\[(.*)\]$", "$1")
    head = F.concat(F.lit("---\nid: "), value("id"), F.lit("\nkind: "), value("kind"), F.lit("\nfile: "), value("file"), F.lit("\n---\n\n# "), F.col("label"), F.lit("\n"))
    body = F.when(text("description") != "", F.concat(F.lit("\n"), "description", F.lit("\n"))).otherwise("")
    tail = F.when(F.col("links").isNotNull(), F.concat(F.lit("\n## Links\n\n"), "links", F.lit("\n"))).otherwise("")
    return g.nodes.join(paths, "id").join(links, "id", "left").select("path", F.concat(head, body, tail).alias("text"))


def write_vault(g: Graph, folder: str) -> int:
    """The notes as files under ``folder``, written by tasks; the number written. Nodes that share a path share a note, their texts in order.

    All notes are staged before the first is put in its place; notes of nodes that are gone stay.
    """
    every = notes(g).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    return write_files(every.select(F.concat("path", F.lit(".md")).alias("path"), "text"), folder)
