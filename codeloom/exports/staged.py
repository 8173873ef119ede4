"""Files that tasks write and that are published when all of them are there (rows K1, K2, K5).

A data source stages files in a folder beside the target: a task writes into a folder of its own attempt, and the commit lists
the attempts that count, so what failed and repeated attempts left is never published. A second job then moves the files. The rows of
one document are staged as a sorted table, compressed; its files are measured, and then each is written at its place in the document. These jobs
can be repeated. Until the end the old output is untouched.

Targets are paths that driver and executors share as files (a mounted folder); graphs elsewhere are kept as tables.
"""

from __future__ import annotations

import gc
import json
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_DONE = "_committed"
_STAGE = ".staged-"
#: Rows of a sorted file that a task looks at together.
_ROWS = 4096


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote: its folder, its place among the tasks, and (section, rows, bytes) of each piece."""

    folder: str
    partition: int
    pieces: list[tuple[int, int, int]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, stage: str):
        self.stage = stage

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        partition = TaskContext.get().partitionId()
        own = Staged(f"{self.stage}/{partition:07d}-{uuid.uuid4().hex}", partition)
        os.makedirs(own.folder)
        own.pieces = self.put(iterator, own.folder)
        return own

    def put(self, batches: Iterator[pa.RecordBatch], folder: str) -> list[tuple[int, int, int]]:
        raise NotImplementedError

    def commit(self, messages: list[Staged | None]) -> None:
        found = [[os.path.basename(m.folder), m.partition, m.pieces] for m in messages if m is not None and m.pieces]
        os.makedirs(self.stage, exist_ok=True)
        with open(f"{self.stage}/{_DONE}.tmp", "w", encoding="utf-8") as f:
            json.dump(found, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.stage}/{_DONE}.tmp", f"{self.stage}/{_DONE}")

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class _FilesWriter(_Writer):
    def put(self, batches, folder):
        n = size = 0
        for b in batches:
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                target = os.path.join(folder, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                data = (text or "").encode()
                with open(target, "wb") as f:
                    f.write(data)
                n, size = n + 1, size + len(data)
        return [(0, n, size)] if n else []


class StagedFiles(DataSource):
    """Rows (path, text), each a file below the folder of its task's attempt."""

    @classmethod
    def name(cls) -> str:
        return "codeloom_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite):
        return _FilesWriter(self.options["stage"])


def _stage(rows: DataFrame, source: type[DataSource], stage: str) -> list[tuple[str, int, list]]:
    rows.sparkSession.dataSource.register(source)
    os.makedirs(stage)
    rows.write.format(source.name()).mode("append").option("stage", stage).save()
    return _committed(stage)


def _committed(stage: str) -> list[tuple[str, int, list]]:
    """(folder, partition, pieces) of the attempts that count: one row a task."""
    with open(f"{stage}/{_DONE}", encoding="utf-8") as f:
        return [(f"{stage}/{name}", partition, pieces) for name, partition, pieces in json.load(f)]


def _in_tasks(spark: SparkSession, rows: list[tuple], schema: str, each: Callable[..., None]) -> None:
    """``each`` for every row, a task a row. Must bear being done twice."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                each(**row)
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    if rows:
        spark.createDataFrame(rows, schema).repartition(len(rows)).mapInArrow(run, "n long").agg(F.sum("n")).first()


def _let_go(spark: SparkSession) -> None:
    """Has the files of ended shuffles deleted, which otherwise stay until the driver happens to collect its garbage: a document may need their room."""
    gc.collect()
    if (jvm := getattr(spark, "_jvm", None)) is not None:
        jvm.System.gc()


def _put(rows: DataFrame, folder: str) -> None:
    rows.write.option("compression", "zstd").parquet(f"file://{folder}")


def _taken(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet("file://" + re.sub(r"([\\{}\[\]*?])", r"\\\1", folder))


def _texts(source: str, section: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """(section, JSON texts) of a file of sorted rows, part by part."""
    for b in pq.ParquetFile(source).iter_batches(_ROWS, columns=["section", "json"]):
        for k in b.column("section").unique().to_pylist() if section is None else [section]:
            texts = b.column("json").filter(pc.equal(b.column("section"), k))
            if len(texts):
                yield k, texts


def _measured(spark: SparkSession, sources: list[str]) -> list[tuple[int, str, int, int]]:
    """(section, file, rows, bytes) of each piece that one of the files has of a section, in the order of the document. Rows stand a line apart."""

    def run(batches):
        for b in batches:
            for source in b.column("source").to_pylist():
                found: dict[int, list[int]] = {}
                for k, texts in _texts(source):
                    own = found.setdefault(k, [0, -2])
                    own[0] += len(texts)
                    own[1] += pc.sum(pc.binary_length(texts)).as_py() + 2 * len(texts)
                for k, (n, size) in found.items():
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([source]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["section", "source", "n", "size"])

    if not sources:
        return []
    asked = spark.createDataFrame([(s,) for s in sources], "source string").repartition(len(sources))
    return sorted(tuple(r) for r in asked.mapInArrow(run, "section int, source string, n long, size long").collect())


def pending(folder: str) -> list[str]:
    """Stages below ``folder`` that were committed and not yet published to the end, oldest first."""
    stages = [e.path for e in os.scandir(folder) if e.name.startswith(_STAGE)] if os.path.isdir(folder) else []
    done = [(os.path.getmtime(f"{s}/{_DONE}"), s) for s in stages if os.path.exists(f"{s}/{_DONE}")]
    return [s for _, s in sorted(done)]


def publish(spark: SparkSession, folder: str) -> int:
    """Moves the files of every committed stage to their places; the number of files of the last one. Safe to repeat after a crash."""
    n = 0
    for stage in pending(folder):
        parts = _committed(stage)

        def move(attempt: str) -> None:
            for at, _, names in os.walk(attempt):
                place = os.path.normpath(os.path.join(folder, os.path.relpath(at, attempt)))
                os.makedirs(place, exist_ok=True)
                for name in names:
                    try:
                        os.replace(os.path.join(at, name), os.path.join(place, name))
                    except FileNotFoundError:
                        # another attempt of this task has moved it
                        if not os.path.exists(os.path.join(place, name)):
                            raise

        _in_tasks(spark, [(p[0],) for p in parts], "attempt string", move)
        shutil.rmtree(stage)
        n = sum(rows for _, _, pieces in parts for _, rows, _ in pieces)
    return n


def write_files(rows: DataFrame, folder: str) -> int:
    """``rows(path, text)`` as files below ``folder``; other files there stay. The number of files.

    Paths must be distinct and relative. A null text is an empty file. If the write fails or is cut off, no file of
    ``folder`` has changed; once it was committed, ``publish`` ends what was cut off.
    """
    stage = f"{folder}/{_STAGE}{uuid.uuid4().hex}"
    _stage(rows.select("path", "text"), StagedFiles, stage)
    return publish(rows.sparkSession, folder)


def write_document(sections: dict[str, DataFrame], path: str, head: dict | None = None, tail: Callable[[dict[str, int]], dict] | None = None) -> dict[str, int]:
    """One JSON object: the fields of ``head``, an array of the rows (ord, json) of each section in order of ord, the fields of ``tail`` (given the counts).

    Rows are sorted into compressed files, then each file is written at its place in a file beside ``path``, which takes the place of ``path``
    at the end: no task and no driver sees all rows, the document's text is on disk once, and a failed write leaves the old document. Every row
    is a line. Rows of equal ord are ordered by their text. The counts of all sections are returned.
    """
    spark = next(iter(sections.values())).sparkSession
    names = list(sections)
    rows = None
    for k, df in enumerate(sections.values()):
        df = df.select(F.lit(k).alias("section"), "ord", "json")
        rows = df if rows is None else rows.unionByName(df)
    order = ["section", "ord", "json"]
    parent = os.path.dirname(os.path.abspath(path))
    os.makedirs(parent, exist_ok=True)
    stage = f"{parent}/{_STAGE}{uuid.uuid4().hex}"
    try:
        # sorting by ranges looks at the rows twice: they are made once
        os.makedirs(stage)
        _put(rows, f"{stage}/rows")
        _put(_taken(spark, f"{stage}/rows", rows.schema).repartitionByRange(*order).sortWithinPartitions(*order).select("section", "json"), f"{stage}/sorted")
        shutil.rmtree(f"{stage}/rows")
        _let_go(spark)
        pieces = _measured(spark, [e.path for e in os.scandir(f"{stage}/sorted") if e.name.startswith("part-")])
        counts = {name: sum(p[2] for p in pieces if p[0] == k) for k, name in enumerate(names)}
        joints: list[tuple[int, bytes]] = []
        copies: list[tuple[str, int, int]] = []
        at = 0

        def joint(text: str) -> None:
            nonlocal at
            joints.append((at, text.encode()))
            at += len(text.encode())

        fields = lambda values: "".join(f"{json.dumps(k)}:{json.dumps(v)}," for k, v in values.items())
        joint("{" + fields(head or {}))
        for k, name in enumerate(names):
            joint(f"{'],' if k else ''}{json.dumps(name)}:[\n")
            own = [p for p in pieces if p[0] == k]
            for i, (_, source, _, size) in enumerate(own):
                if i:
                    joint(",\n")
                copies.append((source, k, at))
                at += size
            joint("\n")
        end = fields(tail(counts) if tail else {})
        joint("]" + ("," + end[:-1] if end else "") + "}\n")
        target = f"{stage}/document"
        with open(target, "wb") as f:
            for place, data in joints:
                f.seek(place)
                f.write(data)

        def copy(source: str, section: int, place: int) -> None:
            with open(target, "r+b") as f:
                f.seek(place)
                for i, (_, texts) in enumerate(_texts(source, section)):
                    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), ",\n")
                    f.write((",\n" * bool(i) + whole[0].as_py()).encode())
                f.flush()
                os.fsync(f.fileno())

        _in_tasks(spark, copies, "source string, section int, place long", copy)
        with open(target, "r+b") as f:
            os.fsync(f.fileno())
        os.replace(target, path)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return counts
