"""Connected components of an edge table, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import join_counted, shared_folder


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of each node of ``edges(a, b)``; loops and nulls are left out.

    In a round each node points its larger neighbours, then itself and its smaller ones, at the least of
    them; both are minima that combine before the shuffle. Rounds grow with the logarithm of the longest
    path. Each ends in a checkpoint in the shared folder; only a count and a sum come to the driver. Nodes of
    very many edges have their least neighbour broadcast, so their edges don't meet in one task."""
    shared_folder(edges.sparkSession)
    stars = (
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    )
    seen = None
    for _ in range(most_rounds):
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                stars.select("v", "v").distinct()
            )
        seen = state
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both, least, ["u"], "n", state[0]).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, least, ["u"], "n", state[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.union(least.select("u", "m")).distinct().checkpoint()
    raise RuntimeError(f"components are not stable after {most_rounds} rounds")
