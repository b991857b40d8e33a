"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedwright.staging import stage


def _state(edges: DataFrame) -> tuple[int, int]:
    line = edges.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.lit(0)).alias("h")
    ).first()
    return line["n"], line["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    linked = edges.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return linked.unionByName(least.select("u", F.col("least").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (u, v); the component is its smallest node.

    Each round is a few joins and aggregates with map-side combine, staged in the shared folder; a node with many
    neighbours is never gathered, and adaptive execution may split its join. Loops and repeated edges change nothing.
    """
    larger, smaller = F.greatest("u", "v"), F.least("u", "v")
    state = stage(
        edges.where("u <> v").select(larger.alias("u"), smaller.alias("v")).distinct(), "components"
    )
    before = _state(state)
    while before[0]:
        state = stage(_small_star(_large_star(state).distinct()).distinct(), "components")
        after = _state(state)
        if after == before:
            break
        before = after
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
