"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(low, "u").filter("v > u AND v <> m")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(id, root) for every node of an undirected edge table; root is the smallest id of the component.

    Rounds grow with the logarithm of the component size; every group step is a partial aggregate and every
    join has one row per node on one side, so a hub holding much of the graph splits under AQE.
    """
    edges = edges.select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    ).filter("u <> v").distinct()
    edges = materialise(edges)
    seen = _digest(edges)
    while True:
        edges = materialise(_small_star(_large_star(edges)))
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)
