"""Query op11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .rankbpe import round_trip

RANKS = "byte_bpe_50k.tiktoken"


def op11_rankbpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids by the rank file of every whole text, and the bytes decoded from them, as digests; a null text is an empty one. Repeated rows give a row each."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), RANKS, ["doc_id"])


QUERIES = {"op11_rankbpe": op11_rankbpe}
SQL: dict[str, str] = {}
