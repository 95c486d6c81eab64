"""Ancestor sets as lane ranges, found in as many rounds as merges and forks are nested."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.graph import Graph
from palimpsest.shared import settle


def reach(graph: Graph, seeds: DataFrame) -> DataFrame:
    """lane, top: every commit on the lane up to that place is a seed or an ancestor of one.

    ``seeds`` has lane and pos.
    """
    fresh = settle(seeds.groupBy("lane").agg(F.max("pos").alias("top")))
    found = [fresh]
    while True:
        ranges = reduce(DataFrame.unionByName, found).groupBy("lane").agg(F.max("top").alias("top"))
        over = graph.cross.join(fresh, F.col("c_lane") == F.col("lane")).filter("c_pos <= top")
        moved = over.groupBy(F.col("p_lane").alias("lane")).agg(F.max("p_pos").alias("new"))
        fresh = settle(moved.join(ranges, "lane", "left").filter("top is null or new > top").select("lane", F.col("new").alias("top")))
        if fresh.isEmpty():
            return ranges
        found.append(fresh)


def within(commits: DataFrame, ranges: DataFrame) -> DataFrame:
    """The commits inside lane ranges."""
    return commits.join(ranges, "lane").filter("pos <= top").drop("top")


def ancestors(graph: Graph, commit_id: int) -> DataFrame:
    """The commit and all its ancestors, in order of hash."""
    return within(graph.commits, reach(graph, graph.places([commit_id]))).orderBy("hash")


def is_ancestor(graph: Graph, older: int, newer: int) -> bool:
    """Whether ``older`` is ``newer`` or an ancestor of it."""
    found = reach(graph, graph.places([newer]))
    return not within(graph.places([older]), found).isEmpty()


def reachable(graph: Graph) -> DataFrame:
    """Lane ranges of what any branch reaches."""
    return reach(graph, graph.tips())
