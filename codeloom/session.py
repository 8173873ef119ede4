"""Sessions and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, app: str = "codeloom", **conf: str) -> SparkSession:
    """A local session for tests and benches: UTC, AQE on, few shuffle partitions."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, which driver and executors share; one of our own only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/codeloom-graph"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's checkpoint folder and read again: lineage is cut in a form that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a part of ``dealt``, about.
PART_ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *keys: str, most: int = PART_ROWS) -> DataFrame:
    """``df`` of some ``rows`` rows dealt by ``keys`` into parts of about ``most``: more rows give more tasks, not larger ones. A table of one part stays as it is."""
    parts = -(-rows // most)
    return df.repartition(parts, *keys) if parts > 1 else df


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in ``order``, by range partitions; no task sees all rows.

    The numbering is dense. One count for each partition is read by the driver.
    """
    mark = "__mark"
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id())
    kept = scratch(sorted_, "numbered")
    part = F.shiftright(mark, 33).cast("int")
    counts = {r[0]: r[1] for r in kept.groupBy(part.alias("p")).count().collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    offset = F.element_at(F.array(*[F.lit(b) for b in before]), part + 1) if before else F.lit(0)
    return kept.withColumn(name, offset + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))).drop(mark)
