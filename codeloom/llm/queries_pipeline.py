"""Query pipeline: all stages of corpus_pipeline.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of every document that all stages keep; see the stages for what becomes of nulls, repeats and empty tables."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
SQL: dict[str, str] = {}
