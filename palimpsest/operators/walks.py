"""Walks of bounded length from many commits at once.

A walk moves along lanes and over cross edges.  It is kept as the stretches of lanes it enters: the
place of entry and the length so far.  Everything further along that lane follows by subtraction, so
the number of rounds is the number of cross edges that a walk can take within its bound, not its
length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.graph import Graph
from palimpsest.shared import settle

#: Bound of walks whose pattern leaves it open.
OPEN_BOUND = 64
#: Lanes are cut into buckets of so many places, so that a range of places joins by equality.
BUCKET = 64


def _stretches(cross: DataFrame, sources: DataFrame, most: int, down: bool) -> DataFrame:
    """src, lane, pos, depth of every entry, depths below the bound; ``down`` goes toward the root."""
    came, went = ("c", "p") if down else ("p", "c")
    at = settle(sources.select("src", "lane", "pos", F.lit(0).cast("long").alias("depth")).distinct())
    found = [at]
    steps = cross.select(F.col(f"{came}_lane").alias("lane"), F.col(f"{came}_pos").alias("leave"), F.col(f"{went}_lane").alias("to_lane"), F.col(f"{went}_pos").alias("to_pos"))
    steps = steps.withColumn("bucket", F.floor(F.col("leave") / BUCKET))
    while True:
        along = F.col("pos") - F.col("leave") if down else F.col("leave") - F.col("pos")
        # only the edges that leave within reach: a lane with many edges does not join as a whole
        far = F.lit(most) - F.col("depth")
        low, high = (F.greatest(F.col("pos") - far, F.lit(0)), F.col("pos")) if down else (F.col("pos"), F.col("pos") + far)
        near = at.withColumn("bucket", F.explode(F.sequence(F.floor(low / BUCKET), F.floor(high / BUCKET))))
        moved = near.join(steps, ["lane", "bucket"]).withColumn("along", along).filter(F.col("along") >= 0).withColumn("depth", F.col("depth") + F.col("along") + 1)
        moved = moved.filter(F.col("depth") <= most).select("src", F.col("to_lane").alias("lane"), F.col("to_pos").alias("pos"), "depth").distinct()
        every = reduce(DataFrame.unionByName, found)
        at = settle(moved.join(every, ["src", "lane", "pos", "depth"], "left_anti"))
        if at.isEmpty():
            return every
        found.append(at)


def walks(graph: Graph, sources: DataFrame, least: int, most: int, down: bool, ranges: DataFrame | None = None) -> DataFrame:
    """src, dst, depth (the smallest in bounds): commits at the end of a walk of least..most steps.

    ``sources`` has src (a commit_id), lane and pos.  ``down`` follows parents, else children; children
    count only inside ``ranges``.  A source is never its own end.  Each pair comes once.
    """
    least = max(least, 1)
    cross = graph.cross
    if ranges is not None:
        cross = cross.join(ranges.withColumnRenamed("lane", "c_lane"), "c_lane").filter("c_pos <= top").drop("top")
    entered = _stretches(cross, sources, most, down)
    far = F.lit(most) - F.col("depth")
    low, high = (F.greatest(F.col("pos") - far, F.lit(0)), F.col("pos")) if down else (F.col("pos"), F.col("pos") + far)
    spans = entered.select("src", "lane", F.col("pos").alias("entry"), "depth", low.alias("low"), high.alias("high"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / BUCKET), F.floor(F.col("high") / BUCKET))))
    places = graph.commits.select(F.col("commit_id").alias("dst"), "lane", "pos", F.floor(F.col("pos") / BUCKET).alias("bucket"))
    if ranges is not None:
        places = places.join(ranges, "lane").filter("pos <= top").drop("top")
    met = spans.join(places, ["lane", "bucket"]).filter("pos between low and high and src <> dst")
    met = met.withColumn("depth", F.col("depth") + F.abs(F.col("pos") - F.col("entry"))).filter(F.col("depth").between(least, most))
    return met.groupBy("src", "dst").agg(F.min("depth").alias("depth"))


def within_depth(graph: Graph, commit_id: int, most: int) -> DataFrame:
    """dst, depth of the ancestors at most so many steps away, the commit itself left out."""
    return walks(graph, graph.places([commit_id]).withColumnRenamed("commit_id", "src"), 1, most, True).select("dst", "depth")


def history(graph: Graph, commit_id: int, length: int) -> DataFrame:
    """step (0 is the tip) and commit_id along first parents, at most ``length`` commits.

    A lane is a line of first parents; only a walk that leaves its lane needs more than a range of it.
    """
    at = graph.places([commit_id]).join(graph.lanes, "lane").select("lane", "pos", "fork_pos").first()
    if at is not None and at["pos"] - length >= (-1 if at["fork_pos"] is None else at["fork_pos"]):
        own = graph.commits.filter((F.col("lane") == at["lane"]) & F.col("pos").between(at["pos"] - length + 1, at["pos"]))
        return own.select((F.lit(at["pos"]) - F.col("pos")).alias("step"), "commit_id")
    first = Graph(graph.spark, graph.commits, graph.edges, graph.ops, graph.lanes, graph.cross.filter("ordinal = 0"), graph.refs, graph.head)
    tip = graph.places([commit_id])
    older = walks(first, tip.withColumnRenamed("commit_id", "src"), 1, length - 1, True)
    return tip.select(F.lit(0).cast("long").alias("step"), "commit_id").unionByName(older.select(F.col("depth").alias("step"), F.col("dst").alias("commit_id"))).filter(F.col("step") < length)
