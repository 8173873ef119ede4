"""op4 where many rows are equal."""

import pytest
from pyspark.sql import functions as F

from codeloom.llm import sharding


@pytest.fixture(scope="module")
def hot(spark):
    equal = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("s").alias("source"))
    copies = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    rest = spark.range(3_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.lit("r").alias("source"))
    return equal.unionByName(copies).unionByName(rest)


def _law(df, shards):
    """Every slot once, gapless from 0, and counts at most one apart."""
    got = df.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("least"), F.max("slot").alias("most")).collect()
    assert len(got) == shards and all((r.d, r.least, r.most) == (r.n, 0, r.n - 1) for r in got)
    assert max(r.n for r in got) - min(r.n for r in got) <= 1


def test_equal_rows_go_to_many_tasks(hot):
    got = sharding.shuffled(hot, shards=8, bucket_bytes=400_000)
    _law(got, 8)
    columns = ["doc_id", "text", "source"]
    counts = lambda df: sorted(map(repr, df.groupBy(*columns).count().collect()))
    assert counts(got) == counts(hot)
    of = {r.p: r.n for r in got.where("doc_id is null").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    assert len(of) > 15 and max(of.values()) < 2 * 100_000 / len(of)


def test_equal_rows_in_other_files(hot):
    key = lambda df: sorted(map(repr, sharding.shuffled(df, shards=5, bucket_bytes=400_000).collect()))
    assert key(hot) == key(hot.repartition(7, F.rand(3)))


def test_only_equal_rows_and_few_bytes_a_block(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 1000)
    df = spark.range(5_000).select(F.lit(1).alias("doc_id"), F.lit("a b").alias("text"))
    got = sharding.shuffled(df, shards=3, bucket_bytes=20_000)
    _law(got, 3)
    assert got.count() == 5_000


@pytest.mark.parametrize("extra", ["map('k', id % 2)", "double(-0.0)"])
def test_rows_that_are_not_counted(spark, extra):
    df = spark.range(2_000).select(F.lit(1).alias("doc_id"), F.lit("a b").alias("text"), F.expr(extra).alias("extra"), (F.col("id") % 40).alias("mark"))
    got = sharding.shuffled(df, shards=4, bucket_bytes=10_000)
    _law(got, 4)
    values = lambda d: sorted(repr((r.extra, r.mark)) for r in d.collect())
    assert values(got) == values(df) and got.select(F.spark_partition_id()).distinct().count() > 5


def test_size_of_buckets():
    assert sharding._bucket_bytes(0) == 24 << 20 and sharding._bucket_bytes(10**12) == 24 << 20
    assert sharding._bucket_bytes(10**13) == 2 * 10**8 and sharding._bucket_bytes(10**14) == 1 << 30
