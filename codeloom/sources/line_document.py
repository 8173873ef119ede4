"""Graph documents with a row a line, read in ranges of bytes (rows S1, S2): one large document is many tasks' work."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_FIRST = b'{"nodes":[\n'
#: How a line of each section begins.
_STARTS = {"nodes": b'{"id":', "edges": b'{"from":'}
_BYTES = 4 << 20


@dataclass
class Range(InputPartition):
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, section: str, split: int):
        self.path, self.starts, self.split = path, _STARTS[section], split

    def partitions(self) -> list[Range]:
        """Ranges with lines of the section. Rows of a section stand together, so between two rows of another one there are none."""
        size = os.path.getsize(self.path)
        ends = [*range(0, size, self.split), size]
        with open(self.path, "rb") as f:
            others = [self._other(f, at) for at in ends]
        return [Range(a, b) for a, b, x, y in zip(ends, ends[1:], others, others[1:], strict=False) if not (x and x == y)]

    def _other(self, f: BinaryIO, at: int) -> bytes | None:
        """How the first line that begins at ``at`` or later begins, if it is a row of another section."""
        if at:
            f.seek(at - 1)
            f.readline()
        else:
            f.seek(0)
        begin = f.read(max(map(len, _STARTS.values())))
        return next((x for x in _STARTS.values() if x != self.starts and begin.startswith(x)), None)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the range; the first byte of a line is its ord."""
        with open(self.path, "rb") as f:
            at = partition.start
            if at:
                # the line that holds the byte before is another range's
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.end:
                block = f.read(min(_BYTES, partition.end - at))
                if not block:
                    break
                if not block.endswith(b"\n"):
                    block += f.readline()
                places, rows = _rows(block, self.starts)
                if len(rows):
                    yield pa.record_batch([pa.array(places + at), rows], names=["ord", "json"])
                at += len(block)


def _rows(block: bytes, starts: bytes) -> tuple[np.ndarray, pa.Array]:
    """Places and texts of the lines of ``block`` that begin with ``starts``."""
    ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 10) + 1
    if not len(ends) or ends[-1] < len(block):
        ends = np.append(ends, len(block))
    places = np.concatenate([[0], ends]).astype(np.int32)
    all_lines = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(block)])
    own = pc.starts_with(all_lines, pattern=starts)
    texts = all_lines.filter(own)
    try:
        texts = texts.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
    return places[:-1][own.to_numpy(zero_copy_only=False)].astype(np.int64), pc.ascii_rtrim(texts, characters=",\n")


class LineDocument(DataSource):
    """(ord, json) of the section ``section`` of the document ``document``, ranges of ``split`` bytes."""

    @classmethod
    def name(cls) -> str:
        return "codeloom_document"

    def schema(self) -> str:
        return "ord long, json string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["document"], self.options["section"], int(self.options.get("split", 32 << 20)))


def in_lines(path: str) -> bool:
    """Whether ``path`` is one document with a row a line, as this library writes them, in a mounted folder."""
    path = path.removeprefix("file://")
    if not os.path.isfile(path):
        return False
    with open(path, "rb") as f:
        return f.read(len(_FIRST)) == _FIRST


def lines(spark: SparkSession, path: str, section: str, split: int = 32 << 20) -> DataFrame:
    """(ord, json): the rows of ``section`` in the document ``path``."""
    spark.dataSource.register(LineDocument)
    return spark.read.format(LineDocument.name()).option("document", path.removeprefix("file://")).option("section", section).option("split", str(split)).load()
