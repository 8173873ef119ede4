"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import gathered, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges(a, b)`` reaches. Nodes without an edge are not returned.

    Each round replaces the edges by links to a neighbourhood's least node, with grouped minima and joins only: no
    neighbour list is ever collected, so a node of any degree is a skewed join for AQE and nothing more. Rounds are
    written tables, in as many files as their rows need; the number of rounds grows with the logarithm of the longest path. Nulls are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    rows, before = e.count(), None
    while True:
        # neither star makes more than two rows of an edge
        both = gathered(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * rows)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(gathered(gathered(large, rows).distinct(), rows), "large")
        low = gathered(large, rows).groupBy("a").agg(F.min("b").alias("m"))
        small = gathered(large, rows).join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = written(gathered(gathered(small.where("a <> b"), rows).distinct(), rows), "small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return gathered(e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b")), 2 * rows).distinct()
        rows, before = now[0], now
