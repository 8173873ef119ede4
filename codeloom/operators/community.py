"""Communities (rows A6, A7, A8): label propagation over joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import numbered as rows_numbered
from codeloom.session import scratch, shared_folder


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): each node repeatedly takes the label that weighs most among its neighbours and itself, the least of equals.

    Edges count in both directions, parallel ones together. Ids are numbered once, in their order, so that rounds join, add up
    and compare numbers. The weights lie in buckets by one end: a round moves the labels to them and one vote for each
    pair of neighbours back, and no table twice. Rounds are written, and stop when no label changes. Isolated nodes keep their own.
    """
    spark = nodes.sparkSession
    pairs = scratch(edges.select("src", "dst").where("src <> dst"), "pairs")
    own = nodes.select("id", F.lit(True).alias("node"))
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(None).cast("boolean").alias("node"))
    every = scratch(own.unionByName(ends).groupBy("id").agg(F.max("node").alias("node")), "ids")
    named = scratch(rows_numbered(every, ["id"], "k"), "numbers")
    strange = not named.where("node is null").isEmpty()
    for end in ("src", "dst"):
        pairs = pairs.join(named.select(F.col("id").alias(end), F.col("k").alias(f"{end}_k")), end).drop(end)
    turned = F.explode(F.array(F.struct(F.col("src_k").alias("k"), F.col("dst_k").alias("of")), F.struct(F.col("dst_k").alias("k"), F.col("src_k").alias("of"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    weights = pairs.select(turned.alias("x")).select("x.*").repartition(parts, "of").groupBy("k", "of").agg(F.count("*").alias("w"))
    table = f"weights_{uuid.uuid4().hex}"
    weights.write.bucketBy(parts, "of").option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    weights = spark.table(table)
    labels = named.where("node").select("k", F.col("k").alias("label"))
    # what weighs most, then the least label, as one number, so that it is added up by hash; bits(nodes) + bits(edges) seldom pass 62
    nodes_bits, total = named.count().bit_length(), weights.agg(F.sum("w")).first()[0] or 0
    kind = "long" if nodes_bits + total.bit_length() <= 61 else "decimal(38,0)"
    base = F.lit(1 << nodes_bits).cast(kind)
    packed = F.min(F.col("label").cast(kind) - F.col("w").cast(kind) * base)
    for turn in range(rounds):
        mine = labels.select("k", "label", F.lit(1).cast("long").alias("w"), F.col("label").alias("old"))
        if turn == 0:
            # pairs stand both ways: what they say of ``of`` already lies in its bucket, and no neighbour has a node's own label yet
            said = weights.select(F.col("of").alias("k"), F.col("k").alias("label"), "w")
            said = said.join(labels.select(F.col("k").alias("label")), "label", "left_semi") if strange else said
            votes = said.groupBy("k").agg(packed.alias("p")).join(mine.select("k", "old", (F.col("label").cast(kind) - base).alias("q")).hint("shuffle_hash"), "k", "full")
            best = votes.select("k", F.least("p", "q").alias("p"), "old")
        else:
            votes = weights.join(labels.withColumnRenamed("k", "of").hint("shuffle_hash"), "of").select("k", "label", "w", F.lit(None).cast("long").alias("old"))
            votes = votes.unionByName(mine).repartition(parts, "k").groupBy("k", "label").agg(F.sum("w").alias("w"), F.max("old").alias("old"))
            best = votes.groupBy("k").agg(packed.alias("p"), F.max("old").alias("old"))
        best = scratch(best.select("k", F.pmod("p", base).cast("long").alias("label"), "old"), "labels")
        labels = best.select("k", "label")
        if best.where("label <> old").isEmpty():
            break
    name = named.select("k", "id")
    out = labels.join(name, "k").select("id", F.col("label").alias("k")).join(name.withColumnRenamed("id", "label"), "k").select("id", "label")
    out = scratch(out, "labelled")
    spark.sql(f"DROP TABLE {table}")
    return out


def numbered(labels: DataFrame) -> DataFrame:
    """(id, community): communities numbered from 0 by size, then label."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    order = rows_numbered(sizes, [F.desc("n"), "label"], "community").select("label", F.col("community").cast("int").alias("community"))
    return labels.join(order, "label").select("id", "community")


def apply_communities(nodes: DataFrame, partition: DataFrame) -> DataFrame:
    """Nodes with the community of ``partition(id, community)``, 0 where it has none."""
    return nodes.drop("community").join(partition, "id", "left").withColumn("community", F.coalesce("community", F.lit(0)))
