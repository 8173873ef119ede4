"""Tables written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where the session names none."""
    path = spark.conf.get(_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set(_KEY, path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a part of ``gathered``, about.
PART_ROWS = 1 << 17


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most some ``rows`` rows in a task for each PART_ROWS of them: shuffles and tables of few rows leave few files, those of many rows stay as they are."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


def spare(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so; case does not tell names apart."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def carried(df: DataFrame, columns: list[str], value: str) -> tuple[DataFrame, Callable[[str], StructType]]:
    """(kept: a struct of ``columns``, value: the column ``value``), and the schema of kept with more columns; no name in the struct can clash with another."""
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("kept"), F.col(f"`{value}`").alias("value"))
    return held, lambda more: StructType([held.schema["kept"], *StructType.fromDDL(more).fields])


def spread(df: DataFrame, columns: list[str], made: dict[str, str]) -> DataFrame:
    """The columns in the struct kept, then ``made``: new names of other columns."""
    return df.select(*[F.col(f"kept.`{c}`").alias(c) for c in columns], *[F.col(c).alias(name) for c, name in made.items()])


def narrow_batches(spark: SparkSession, max_bytes: int = 8 << 20) -> None:
    """Bounds what an Arrow batch holds, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
