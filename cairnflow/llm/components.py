"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.scratch import scratch_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u")
    return near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).filter("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that it reaches) for each node of ``edges`` (a, b: long).

    Loops and repeated edges are harmless; nodes without another neighbour are left out. Each step needs the
    minimum of a node's neighbours only, so a node with many edges is summed on the map side; its join is one
    that the engine can split. The edges of each round are written to the shared folder. Raises if the stars have
    not settled after ``rounds`` rounds, which grow with the logarithm of the longest chain.
    """
    edges = scratch_table(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        edges = scratch_table(_small_star(_large_star(edges)), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
