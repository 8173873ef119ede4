"""Two-pass external shuffle into shards.

Pass one scatters whole records into buckets that fit memory, by a seeded hash of the record's id and text. Pass two brings
each bucket into a canonical order, shuffles it by Fisher-Yates with a seed of its own, and writes it. A record's rank is its
place in its bucket after the records of the buckets before; shards take ranks in turn, so that their row counts differ by
one at most. How many records lie before a bucket travels to it as a row of its own. Rows of one id and text that would fill
much of a bucket are counted instead of sent, and their copies dealt by number, each to the bucket of its own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf as tb
from .scratch import narrow_batches

LAW = "rows"

#: Buckets whose counts are added up by one task.
BLOCK = 4096


def record_size(text: str = "text"):
    """UTF-8 bytes of the text, none for null, plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _before(counts: DataFrame) -> DataFrame:
    """(bucket, before): the records of all buckets of lower number; by blocks, so that one task sees a row for each block only."""
    block = counts.withColumn("block", F.floor(F.col("bucket") / BLOCK))
    sums = block.groupBy("block").agg(F.sum("n").alias("sum"))
    offset = F.coalesce(F.sum("sum").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return block.withColumn("inner", inner).join(sums.select("block", offset.alias("offset")), "block").select("bucket", (F.col("inner") + F.col("offset")).alias("before"))


#: Bytes of a record beside its text.
BESIDE = 64
#: Bytes of equal rows that one block makes again from their count.
COPIES = 64 << 20
#: A share of a bucket: rows of one id and text that take more of it are dealt by number.
SHARE = 8


def _bucket_bytes(total: int) -> int:
    """24 MB, more where that would make over 50,000 buckets, 1 GB at most."""
    return min(max(24 << 20, total // 50_000), 1 << 30)


def _holds(kind: T.DataType, *sought: type[T.DataType]) -> bool:
    """Whether values of a type hold values of one of those sought."""
    if isinstance(kind, T.StructType):
        return any(_holds(f.dataType, *sought) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, *sought)
    return isinstance(kind, sought)


def _dealt(source: DataFrame, hot: DataFrame, seed: int, text: str, countable: bool) -> DataFrame:
    """``source(record, mark, tie)`` with a new mark for the rows whose mark is in ``hot``: of their contents and, among equal rows, their number."""
    rows = source.join(hot, "mark", "left_semi")
    if countable:
        # equal rows are added up on the map side; their copies are made again by many tasks
        groups = rows.groupBy("record", "mark", "tie").agg(F.count("*").alias("n"))
        size = F.coalesce(F.octet_length(F.col("record")[text]), F.lit(0)) + BESIDE
        groups = groups.withColumn("each", F.greatest(F.lit(1), F.floor(F.lit(COPIES) / size)).cast("long"))
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("each")))).alias("block")
        blocks = groups.select("record", "mark", "tie", "n", "each", block).repartition("mark", "tie", "block")
        first = F.col("block") * F.col("each")
        number = F.explode(F.sequence(first, F.least(first + F.col("each"), F.col("n")) - 1)).alias("number")
        rows = blocks.select("record", "mark", "tie", number)
    else:
        rows = rows.withColumn("number", F.lit(0).cast("long"))
    rows = rows.select("record", F.xxhash64(F.lit(seed), "mark", "tie", "number").alias("mark"), "tie")
    return source.join(hot, "mark", "left_anti").select("record", "mark", "tie").unionByName(rows)


def shuffled(docs: DataFrame, shards: int = 8, seed: int = 7, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int | None = None) -> DataFrame:
    """Every row of ``docs`` with all its columns, shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard).

    The same rows with the same seed, shards and bucket size give the same result, however they lie in files and partitions:
    places follow from contents, and rows that differ in nothing can stand for each other. Null ids and texts are hashed like
    any other. Rows that share both id and text share a bucket unless they take over an eighth of its size: then each goes
    where its other columns and, among equal rows, its number send it; copies of a text under different ids always lie apart.
    Rows with a map, variant or floating column are not counted, as grouping might change them: there only rows that differ
    in a column without maps and variants are dealt apart.
    Columns of ``docs`` named shard or slot are replaced. An empty table gives none. A bucket is a task of its own;
    ``bucket_bytes`` None takes 24 MB, and up to 1 GB where the table is large (100,000 buckets at 100 TB).
    """
    narrow_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    plain = [f.name for f in docs.schema if f.name in names and not _holds(f.dataType, T.MapType, T.VariantType)]
    mark = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    # bytes of the rows of each id and text; what takes much of a bucket is rare by its definition: SHARE times the buckets at most
    sizes = docs.select(mark.alias("mark"), (record_size(text) + BESIDE).alias("size")).groupBy("mark").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total, most = sizes.agg(F.sum("bytes"), F.max(F.when(F.col("n") > 1, F.col("bytes")))).first()
    size = bucket_bytes or _bucket_bytes(total or 0)
    buckets = max(1, -(-(total or 0) // size))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("record"), mark.alias("mark"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in plain]).alias("tie"))
    if (most or 0) * SHARE > size:
        countable = not _holds(source.schema["record"].dataType, T.MapType, T.VariantType, T.FloatType, T.DoubleType)
        hot = sizes.where((F.col("n") > 1) & (F.col("bytes") * SHARE > size)).select("mark")
        source = _dealt(source, F.broadcast(hot) if buckets * SHARE <= 1 << 20 else hot, seed, text, countable)
    source = source.withColumn("bucket", F.pmod("mark", F.lit(buckets)).cast("int"))
    none = F.lit(None)
    heads = _before(source.groupBy("bucket").agg(F.count("*").alias("n"))).select(none.cast(source.schema["record"].dataType).alias("record"), none.cast("long").alias("mark"), none.cast("long").alias("tie"), "bucket", "before")
    dealt = source.withColumn("before", none.cast("long")).unionByName(heads).repartitionById(int(buckets), F.col("bucket"))

    def fisher_yates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        before = next(x for x in table.column("before").to_pylist() if x is not None)
        own = np.flatnonzero(~table.column("before").is_valid().to_numpy())
        mark, tie = (table.column(c).to_numpy()[own].astype(np.int64) if table.column(c).null_count == 0 else table.column(c).fill_null(0).to_numpy()[own] for c in ("mark", "tie"))
        order = own[np.lexsort((tie, mark))]
        order = np.random.default_rng([seed, table.column("bucket")[0].as_py()]).permutation(order)
        records, rank = table.column("record"), before + np.arange(len(order))
        for s in range(0, len(order), 2048):
            part = records.take(pa.array(order[s : s + 2048])).combine_chunks()
            r = rank[s : s + 2048]
            yield pa.record_batch([part, pa.array((r % shards).astype(np.int32)), pa.array(r // shards)], names=["record", "shard", "slot"])

    schema = T.StructType([source.schema["record"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return dealt.mapInArrow(tb.returning(fisher_yates), schema).select("record.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 7, text: str = "text") -> None:
    """The shards as Parquet under ``path``, a folder shard=N for each, with slot in every record.

    A shard's records lie in order of their slots: a file of each bucket, in the order of file names, each in order inside.
    """
    shuffled(docs, shards, seed, text).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
