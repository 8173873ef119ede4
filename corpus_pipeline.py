"""Corpus pipeline: language, near duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.bpe import encoded
from codeloom.llm.decontaminate import contamination
from codeloom.llm.langid import UNKNOWN, predict
from codeloom.llm.neardup import one_of_similar
from codeloom.llm.pii import without_personal_data
from codeloom.llm.queries_bpe import tokenizer_path
from codeloom.llm.queries_langid import learned
from codeloom.llm.scratch import spare, written

#: A text of which a smaller share of n-grams belongs to its language is no text of any learned language.
LEAST_SHARE = 0.1

#: The SQL of run()'s rows: language models, fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter, and texts whose n-grams no learned language holds; ``lang`` becomes the predicted one.

    Rows are judged one by one, repeated ones and those without a doc_id too. Without a row that has both a text and a
    language nothing is learned, and no row stays. Other columns are carried along.
    """
    columns = docs.columns
    found, score = spare(columns, "__lang"), spare(columns, "__score")
    named = predict(docs, learned(docs), columns, names=(found, score)).where((F.col(found) != UNKNOWN) & (F.col(score) >= LEAST_SHARE))
    return named.select(*[F.col(found).alias(c) if c == "lang" else F.col(f"`{c}`") for c in columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near duplicates: texts whose sets of five-word shingles have a similarity of 0.8 or more.

    SimHash fingerprints propose links first, buckets of minima those that differ in more bits; whole sets decide. Rows
    without a doc_id come last in a group; null, empty and wordless texts are one group. An empty table stays empty.
    """
    return one_of_similar(docs, least=0.8, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a word inside an occurrence of a benchmark window; each row by its own text, whatever its doc_id.

    Null and empty texts stay, as nothing is found in them. Without benchmark items all rows stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = spare(docs.columns, "__row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    hit = contamination(rows.select(F.col(row).alias("doc_id"), "text"), items, slop=0).where(F.size("hits") > 0).select(F.col("doc_id").alias(row))
    return rows.join(written(hit, "contaminated"), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by <KIND>; n_chars follows the text. Null texts stay null, with a null n_chars; every row stays."""
    return without_personal_data(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of every document; null and empty texts have no ids. Every row stays."""
    return encoded(docs, tokenizer_path(), ["doc_id", "lang", "source"]).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
