"""Query op6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import KINDS, personal_data


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text; a null or empty text has none. Repeated rows give a row each."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.regexp_count("spans", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op6_pii": op6_pii}
SQL: dict[str, str] = {}
