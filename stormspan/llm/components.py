"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormspan.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every neighbour larger than a node is linked to the smallest of the node and its neighbours; and a written table on the way.

    The minima are written first: joined with its own aggregation, whose dealing it would share, a node with very many
    neighbours couldn't be split by adaptive execution.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these; large stars leave few of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only and no larger one."""
    ends = edges.select("u", F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return not ends.groupBy("u").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 OR (low = 1 AND high = 1)").limit(1).count()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From edges (u, v) the columns node and component (its smallest node) of every node that has an edge to another.

    Each round is written to the shared folder. A node with very many edges is never gathered: its minimum is aggregated
    before the shuffle, and adaptive execution may split the join back. Loops and repeated edges do no harm. The number of
    rounds grows with the logarithm of a component's size; more than max_rounds are an error.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for k in range(max_rounds):
        if _are_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        made, least = _large_star(now)
        before, now = now, materialize(_small_star(made.distinct()).distinct(), f"stars{k}")
        discard(before)
        discard(least)
    raise RuntimeError(f"no end after {max_rounds} rounds")
