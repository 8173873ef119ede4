"""Query op7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import encoded_digests

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text as digests; a null text is an empty one with no ids. Repeated rows give a row each."""
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), ["doc_id"])


QUERIES = {"op7_bpe": op7_bpe}
SQL: dict[str, str] = {}
