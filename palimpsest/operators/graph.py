"""The tables of a commit graph.

Commits sit on lanes.  A commit continues its first parent's lane, one place further, if its state
extends that parent's and it is the first to do so; otherwise it opens a lane that forks from the
commit whose state it extends.  Along any line of states the place grows by one each step, and a line
of states, like a set of ancestors, is a short list of ranges (lane, highest place).

commits: commit_id, hash, ts, message, state_base (id or null), lane, pos
edges: child, parent, ordinal (0 is the first parent)
ops: commit_id, lane, pos, op_seq, key, value - what each commit puts, in order
lanes: lane, fork_lane, fork_pos - null for a lane that starts from the empty state
cross: c_lane, c_pos, p_lane, p_pos, ordinal - all edges but those to the place below on the same lane
refs: name, commit_id
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.shared import settle, written

COMMITS = "commit_id long, hash string, ts long, message string, state_base long, lane long, pos long"
EDGES = "child long, parent long, ordinal int"
OPS = "commit_id long, lane long, pos long, op_seq int, key string, value string"
LANES = "lane long, fork_lane long, fork_pos long"
CROSS = "c_lane long, c_pos long, p_lane long, p_pos long, ordinal int"
REFS = "name string, commit_id long"


@dataclass(frozen=True)
class Graph:
    """Tables of one graph, and the branch that HEAD names."""

    spark: SparkSession
    commits: DataFrame
    edges: DataFrame
    ops: DataFrame
    lanes: DataFrame
    cross: DataFrame
    refs: DataFrame
    head: str

    def settled(self) -> Graph:
        """The same graph with its tables computed once, side by side, for several passes over them."""
        steps = ((written, self.commits), (written, self.edges), (written, self.ops), (settle, self.lanes), (settle, self.cross), (settle, self.refs))
        with ThreadPoolExecutor(len(steps)) as pool:
            return Graph(self.spark, *pool.map(lambda step: step[0](step[1]), steps), self.head)

    def tips(self) -> DataFrame:
        """commit_id, lane, pos of every branch's tip."""
        return self.refs.select("commit_id").distinct().join(self.commits.select("commit_id", "lane", "pos"), "commit_id")

    def places(self, commit_ids: list[int]) -> DataFrame:
        """commit_id, lane, pos of some commits."""
        return self.commits.filter(F.col("commit_id").isin(commit_ids)).select("commit_id", "lane", "pos")


def cross_edges(edges: DataFrame, commits: DataFrame) -> DataFrame:
    """The edges that leave their lane, by the places of their ends."""
    place = lambda end, p: commits.select(F.col("commit_id").alias(end), F.col("lane").alias(f"{p}_lane"), F.col("pos").alias(f"{p}_pos"))
    both = edges.join(place("child", "c"), "child").join(place("parent", "p"), "parent")
    inside = (F.col("c_lane") == F.col("p_lane")) & (F.col("c_pos") == F.col("p_pos") + 1) & (F.col("ordinal") == 0)
    return both.filter(~inside).select("c_lane", "c_pos", "p_lane", "p_pos", "ordinal")
