"""Query op2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import quality_scores
from .queries_langid import held_out

THRESHOLD = 0.3


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text, 0 to 1; null and empty texts are scored too, repeated rows each. Nothing but the text is read of a scored row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality_scores(docs, labels, ~held_out(5, 0))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}
