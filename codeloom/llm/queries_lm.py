"""Query op5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .lm import text_scores
from .queries_langid import held_out


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every whole text under a model of those not held out; a null text is an empty one, whose one token is the end."""
    return text_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out(10, 0))


QUERIES = {"op5_lm": op5_lm}
SQL: dict[str, str] = {}
