"""Connected components of an edge table with DataFrame operations alone.

Large-star and small-star steps alternate until the edges stay as they are; what is
left is a star around the smallest node of each component. Each step groups by node
with a minimum (summed before the shuffle) and joins it back, so a node with very many
edges is split like any skewed join. Every round's edges are stored in the shared
folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._common import checkpoint


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges: columns a and b of one ordered type. Returns node and component, the
    smallest node it reaches, for every node of an edge between two different nodes;
    null ends are no nodes. An empty edge table has no nodes."""
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = checkpoint(pairs)
    before = _state(pairs)
    if before[0]:
        for _ in range(most_rounds):
            both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            pairs = checkpoint(small.union(low.select("a", F.col("m").alias("b"))).distinct())
            after = _state(pairs)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
