"""Connected components of a graph by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater import shared


def _state(edges: DataFrame) -> tuple:
    """Count and hash sum: equal only if a round has changed no edge (two sums of 64-bit hashes would have to agree by chance)."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the least node of its component.

    Neighbour lists are never gathered: a round takes each node's least neighbour by an aggregate and joins it back. Each
    round is a table in the shared folder; the one before it is deleted.
    """
    spark = edges.sparkSession
    current, path = shared.written(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), name)
    state = _state(current)
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u's smaller neighbours, and u, all point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        following, new_path = shared.written(small, name)
        before, state = state, _state(following)
        shared.remove(spark, path)
        current, path = following, new_path
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
