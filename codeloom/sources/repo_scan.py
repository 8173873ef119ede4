"""Repository files as tables (rows S5-S8, P5-P7, S17, H2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import is_code_file
from codeloom.operators.ignore import BY_STACK, RULES, default_rules, detect_stack, ignored_paths, ignored_with_parents, rule_rows, rules

#: Files of ignore rules; a folder's own one adds to the shared one.
IGNORE_FILES = (".gitignore", ".codeloomignore")


def _text_of(spark: SparkSession, path: str) -> str:
    """A small file through Spark's file systems, hidden ones too; empty if there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _nested_ignore_files(spark: SparkSession, base: str) -> list[tuple[str, str]]:
    """(folder, text) of the ignore files below the root, level by level; Spark's readers do not see them, as their names start with a dot."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    top = jvm.org.apache.hadoop.fs.Path(base).toUri().getPath()
    found, level = [], base + "/*"
    while len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(level)) or []):
        for name in IGNORE_FILES:
            for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{level}/{name}")) or []:
                path = status.getPath().toUri().getPath()
                found.append((path[len(top) + 1 : -len(name) - 1], _text_of(spark, status.getPath().toString())))
        level += "/*"
    return sorted(found)


def scan(spark: SparkSession, root: str, stack: str = "unknown", extra: list[str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """(path, content, size, mod_time) of the files under ``root`` that no rule leaves out; paths are relative.

    Rules: the stack's defaults, the root's ignore files, ``extra`` lines, and for each folder below its ignore files and the
    defaults of the stack that its files tell; a file out by any list stays out. ``extensions`` are
    matched as they are written; none means all. Spark's readers leave out files whose names start with ``.`` or ``_``, and
    empty files.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    clean = F.regexp_replace("path", "^file:/+", "/")
    rel = F.substr(clean, F.instr(clean, base.removeprefix("file://") + "/") + F.lit(len(base.removeprefix("file://")) + 1))
    files = files.select(rel.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"))
    lists = [default_rules(stack), *(rules(_text_of(spark, f"{base}/{name}").splitlines()) for name in IGNORE_FILES), rules(extra or [])]
    kept = files.where(~ignored_with_parents(F.col("path"), [x for x in lists if x]))
    given: dict[str, list] = {}
    for folder, text in _nested_ignore_files(spark, base):
        given.setdefault(folder, []).append(rules(text.splitlines()))
    table = spark.createDataFrame([row for folder, own in given.items() for row in rule_rows(folder, own)], RULES)
    # the defaults of each folder's stack: a join of the folders with the rules of the stacks, list 99 of a folder
    stacks = spark.createDataFrame([(stack, *row[2:]) for stack in BY_STACK for row in rule_rows("", [default_rules(stack)])], "stack string, ordinal int, regex string, negated boolean, folders_only boolean")
    told = detect_stack(kept.select("path")).where("directory <> ''").join(stacks, "stack")
    table = table.unionByName(told.select(F.col("directory").alias("folder"), F.lit(99).alias("list"), "ordinal", "regex", "negated", F.col("folders_only").alias("directory")))
    kept = kept.join(ignored_paths(kept.select("path"), table), "path", "left_anti").select(*kept.columns)
    if extensions:
        kept = kept.where(F.regexp_extract("path", r"(\.[^./]*)$", 1).isin(*extensions))
    return kept


def code_files(files: DataFrame) -> DataFrame:
    """S8."""
    return files.where(is_code_file(F.col("path")))


def latest_change(files: DataFrame) -> DataFrame:
    """H2."""
    return files.agg(F.max("mod_time").alias("latest"))
