"""Query op12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .periodic import periodic_runs


def _repeating(text: Column, doc_id: Column) -> Column:
    """The text with its words from word a on replaced by the p words there, again and again, in the tenth of documents whose CRC ends in 0; all others as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:  # a variable: written out, the words would be sought again for each of them
        a = g % F.size(words)
        p = 1 + F.floor((F.size(words) - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), 1)
    return F.when((h % 10 == 0) & text.isNotNull(), made).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least four periods of every whole text, the strongest one, and the text collapsed, as digests.

    Null and wordless texts have no runs; a row without a doc_id keeps its words. Repeated rows give a row each.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", _repeating(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs, ["doc_id"])
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.reduce("runs", nothing, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), (F.concat(r["period"].cast("string"), F.lit("\n")))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic": op12_periodic}
SQL: dict[str, str] = {}
