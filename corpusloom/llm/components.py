"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node next to it."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below it are linked to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.filter("u > v").union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(`node`, `component`): for every linked node the least node that it reaches.

    Alternates large-star and small-star steps until every node points at its least one; the number of rounds
    grows with the logarithm of the number of nodes, also for long chains. A hub's rows are pre-aggregated, and
    joins to its minimum are equi-joins that adaptive execution can split. Each round is written to the shared
    folder. Null ends and links of a node to itself are left out; no links give an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = cut_lineage(edges, "links")
    for _ in range(MAX_ROUNDS):
        edges = cut_lineage(_small_star(_large_star(edges)), "stars")
        sources = edges.groupBy("u").count()
        unsettled = sources.filter("count > 1").select("u").union(sources.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u"))
        if unsettled.isEmpty():
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
