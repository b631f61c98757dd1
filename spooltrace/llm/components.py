"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two aggregations and joins over the edge table; nothing is
collected. A node with very many links costs one partial aggregate and a join
that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spooltrace.llm.common import materialize


def _star_round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))  # hi = node, lo = neighbour
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(
        F.col("hi").alias("n"), F.least("hi", "m").alias("m"))
    # large star: larger neighbours hang on the node's smallest neighbour
    large = (both.where("lo > hi").join(least, F.col("hi") == F.col("n"))
             .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct())
    # small star: smaller neighbours and the node itself hang on the smallest
    small = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "n")
    return (large.join(small, F.col("hi") == F.col("n"))
            .select(F.explode(F.array(
                F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo").where("hi <> lo").distinct())


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node hangs on one root and no root hangs on another node."""
    roles = edges.select(F.explode(F.array(
        F.struct(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("lo").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("r")).select("r.*")
    return roles.groupBy("n").agg(F.sum("up").alias("u"), F.max("down").alias("d")) \
        .where("u > 1 OR (u > 0 AND d > 0)").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node in ``links``; the root is the smallest node of the component."""
    edges = materialize(links.where(f"{a} <> {b}").select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    while not _is_star_forest(edges):
        edges = materialize(_star_round(edges), "edges")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return roots.unionByName(edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")))
