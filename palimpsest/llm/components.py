"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.scratch import cut


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end, without loops or nulls."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end: components are then found."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return not ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or out = 1 and in = 1").head(1)


def large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (u, v); the component is its smallest node.

    Both columns are longs.  Loops, repeated edges and edges with a null end are ignored; an empty
    table gives an empty result.  The per-node minimum is combined before each shuffle and the join
    back has one row per node on its right side, so a hub's edges can be split over tasks.
    """
    now = cut(_oriented(edges.select("u", "v").dropna()))
    while not _stars(now):
        now = cut(small_star(large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
