"""File manifests and incremental reuse (rows S9, S10, R10, R11, R17, R18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import language_of


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, size, language, status) of ``files(path, content)``, and mod_time where the files have it."""
    content = F.col("content").cast("binary")
    return files.select("path", F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size"), language_of(F.col("path")).alias("language"), F.lit("active").alias("status"), *[c for c in files.columns if c == "mod_time"])


def diff(saved: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status) over both manifests: new, changed, unchanged or deleted."""
    s = saved.select("path", F.col("sha256").alias("old"))
    c = current.select("path", F.col("sha256").alias("new"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return s.join(c, "path", "full_outer").select("path", status.alias("status"))


def reuse_mode(changes: DataFrame, same_version: bool = True) -> DataFrame:
    """Unchanged, deleted_only or none, with the counts it follows from."""
    n = {k: F.count_if(F.col("status") == k) for k in ("new", "changed", "unchanged", "deleted")}
    dirty = (n["new"] + n["changed"]) > 0
    mode = F.when(F.lit(not same_version) | dirty, "none").when(n["deleted"] > 0, "deleted_only").otherwise("unchanged")
    return changes.agg(mode.alias("mode"), *[c.alias(f"n_{k}") for k, c in n.items()])


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` in place of the rows of the same key."""
    return table.join(rows.select(*key), key, "left_anti").select(*table.columns).unionByName(rows)


def removed(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """R17."""
    return table.join(keys.select(*key), key, "left_anti").select(*table.columns)


def without_prefix(table: DataFrame, prefix: str, column: str = "path") -> DataFrame:
    """R18."""
    return table.where(~F.col(column).startswith(prefix))
