"""Query op9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import LanguageFilter, fit, predict


def held_out(modulus: int, remainder: int):
    """Rows whose crc32 of doc_id as text has that remainder; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def learned(docs: DataFrame) -> LanguageFilter:
    return fit(docs.where(~held_out(4, 2)))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from rows that are not held out; ``und`` without text or letter.

    Repeated rows give a row each; if nothing can be learned, every row is ``und``.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs.withColumn("held_out", held_out(4, 2)), learned(docs), ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op9_langid": op9_langid}
SQL: dict[str, str] = {}
