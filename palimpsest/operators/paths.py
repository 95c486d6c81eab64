"""Distances in a commit graph: merge base and shortest path, over portals.

Portals are the places where a path may change lanes, with its ends.  Between two portals of one lane
a path has as many steps as the places differ, so distances settle in as many rounds as lanes change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.graph import Graph
from palimpsest.operators.reach import reach
from palimpsest.shared import settle


def ancestor_distances(graph: Graph, commit_id: int) -> DataFrame:
    """lane, pos, distance, turns: the shortest way from a commit down to each portal it reaches.

    turns lists where the way leaves first parents, as (-step, ordinal); of equally short ways the
    one with the least turns comes first in a breadth-first search by parent order.
    """
    none = F.array().cast("array<struct<step:bigint,ordinal:int>>")
    found = settle(graph.places([commit_id]).select("lane", "pos", F.struct(F.lit(0).cast("long").alias("distance"), none.alias("turns")).alias("way")))
    fresh = found
    while True:
        moved = graph.cross.join(fresh, F.col("c_lane") == F.col("lane")).filter("c_pos <= pos")
        distance = F.col("way.distance") + F.col("pos") - F.col("c_pos") + 1
        turn = F.array(F.struct((-distance).cast("long").alias("step"), F.col("ordinal").alias("ordinal")))
        turns = F.when(F.col("ordinal") > 0, F.concat("way.turns", turn)).otherwise(F.col("way.turns"))
        moved = moved.select(F.col("p_lane").alias("lane"), F.col("p_pos").alias("pos"), F.struct(distance.alias("distance"), turns.alias("turns")).alias("new"))
        moved = moved.groupBy("lane", "pos").agg(F.min("new").alias("new"))
        fresh = settle(moved.join(found, ["lane", "pos"], "left").filter("way is null or new < way").select("lane", "pos", F.col("new").alias("way")))
        if fresh.isEmpty():
            return found.select("lane", "pos", "way.distance", "way.turns")
        found = settle(found.unionByName(fresh).groupBy("lane", "pos").agg(F.min("way").alias("way")))


def merge_base(graph: Graph, a: int, b: int) -> DataFrame:
    """The commit that a breadth-first search from ``b`` meets first among ``a`` and its ancestors.

    One row of commits, or none.  Not symmetric: distances count from ``b``.
    """
    ranges = reach(graph, graph.places([a]))
    met = ancestor_distances(graph, b).join(ranges, "lane")
    at = F.least("pos", "top")
    met = met.select("lane", at.alias("pos"), F.struct((F.col("distance") + F.col("pos") - at).alias("d"), "turns").alias("way"))
    nearest = met.groupBy("lane", "pos").agg(F.min("way").alias("way")).orderBy("way", "lane", "pos").limit(1).select("lane", "pos")
    return graph.commits.join(nearest, ["lane", "pos"], "left_semi")


def shortest_path(graph: Graph, a: int, b: int) -> DataFrame:
    """step, commit_id: a shortest way from ``a`` to ``b`` over parents and reachable children.

    Empty if there is none.  Of equally short ways the one whose portals come first by (lane, pos).
    """
    tops = reach(graph, graph.tips())
    ends = graph.places([a, b])
    if a == b:
        return ends.limit(1).select(F.lit(0).cast("long").alias("step"), "commit_id")
    cross = graph.cross.join(tops.withColumnRenamed("lane", "c_lane"), "c_lane").filter("c_pos <= top").drop("top", "ordinal")
    own = reach(graph, ends)  # what a or b descend from, reachable or not: parents always count
    down = graph.cross.join(own.withColumnRenamed("lane", "c_lane"), "c_lane").filter("c_pos <= top").drop("top", "ordinal")
    flip = lambda df: df.select(F.col("p_lane").alias("c_lane"), F.col("p_pos").alias("c_pos"), F.col("c_lane").alias("p_lane"), F.col("c_pos").alias("p_pos"))
    jumps = settle(cross.select("c_lane", "c_pos", "p_lane", "p_pos").unionByName(down.select("c_lane", "c_pos", "p_lane", "p_pos")).unionByName(flip(cross)).distinct())
    portals = jumps.select(F.col("c_lane").alias("lane"), F.col("c_pos").alias("to")).unionByName(ends.select("lane", F.col("pos").alias("to"))).distinct()
    portals = settle(portals.join(tops, "lane", "left"))
    node = lambda lane, pos, jumped: F.struct(F.col(lane).alias("lane"), F.col(pos).alias("pos"), F.lit(jumped).alias("jumped"))
    goal = graph.places([b]).select("lane", "pos").first()
    begin = ends.filter(F.col("commit_id") == a).select("lane", "pos", F.struct(F.lit(0).cast("long").alias("d"), F.array(node("lane", "pos", False)).alias("by")).alias("way"))
    found = fresh = settle(begin)
    while True:
        along = fresh.join(portals, "lane").filter("to < pos or to > pos and to <= top").select(
            "lane", F.col("to").alias("pos"), F.struct((F.col("way.d") + F.abs(F.col("to") - F.col("pos"))).alias("d"), F.concat("way.by", F.array(node("lane", "to", False))).alias("by")).alias("new")
        )
        over = fresh.join(jumps, (F.col("lane") == F.col("c_lane")) & (F.col("pos") == F.col("c_pos"))).select(
            F.col("p_lane").alias("lane"), F.col("p_pos").alias("pos"), F.struct((F.col("way.d") + 1).alias("d"), F.concat("way.by", F.array(node("p_lane", "p_pos", True))).alias("by")).alias("new")
        )
        reached = found.filter((F.col("lane") == goal["lane"]) & (F.col("pos") == goal["pos"])).select("way.d").first()
        moved = along.unionByName(over)
        if reached:
            moved = moved.filter(F.col("new.d") <= reached["d"])
        moved = moved.groupBy("lane", "pos").agg(F.min("new").alias("new"))
        fresh = settle(moved.join(found, ["lane", "pos"], "left").filter("way is null or new < way").select("lane", "pos", F.col("new").alias("way")))
        if fresh.isEmpty():
            break
        found = settle(found.unionByName(fresh).groupBy("lane", "pos").agg(F.min("way").alias("way")))
    by = found.filter((F.col("lane") == goal["lane"]) & (F.col("pos") == goal["pos"])).select("way.by")
    legs = by.select("by", F.posexplode("by").alias("i", "to")).withColumn("from", F.when(F.col("i") > 0, F.try_element_at("by", F.col("i"))))
    same = F.col("from").isNotNull() & ~F.col("to.jumped")
    sign = F.when(F.col("to.pos") > F.col("from.pos"), 1).otherwise(-1)
    places = F.when(same, F.sequence(F.col("from.pos") + sign, F.col("to.pos"))).otherwise(F.array("to.pos"))
    steps = legs.select("i", "to.lane", F.posexplode(places).alias("j", "pos"))
    walked = steps.join(graph.commits.select("commit_id", "lane", "pos"), ["lane", "pos"])
    before = F.struct("i", "j")
    ranked = walked.groupBy().agg(F.sort_array(F.collect_list(F.struct(before.alias("at"), "commit_id"))).alias("way"))
    return ranked.select(F.posexplode("way").alias("step", "p")).select(F.col("step").cast("long").alias("step"), "p.commit_id")
