"""Document states rebuilt from the change log: the last put along a line of states wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.graph import Graph
from palimpsest.shared import settle

#: Places of a lane that are scanned in one window; longer lanes are scanned by such chunks.
CHUNK = 8192
#: What a commit with the empty state has as root.
EMPTY_ROOT = "0" * 64


def lineage(graph: Graph, points: DataFrame) -> DataFrame:
    """id, lane, top, level: the lane ranges, nearest first, that hold the states below each point.

    ``points`` has id, lane and pos.
    """
    at = settle(points.select("id", "lane", F.col("pos").alias("top"), F.lit(0).alias("level")))
    every = at
    while True:
        forks = graph.lanes.filter("fork_lane is not null")
        below = at.join(forks, "lane").select("id", F.col("fork_lane").alias("lane"), F.col("fork_pos").alias("top"), (F.col("level") + 1).alias("level"))
        if below.isEmpty():
            return every
        at = settle(below)
        every = every.unionByName(at)


def states(graph: Graph, points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """id, key, value, commit_id (of the put): the state at each point, of some keys or all."""
    ops = graph.ops if keys is None else graph.ops.filter(F.col("key").isin(keys))
    puts = ops.withColumnRenamed("commit_id", "writer").join(lineage(graph, points), "lane").filter("pos <= top")
    newest = F.struct(-F.col("level"), F.col("pos"), F.col("op_seq"))
    last = puts.groupBy("id", "key").agg(F.max_by(F.struct("value", "writer"), newest).alias("put"))
    return last.select("id", "key", "put.value", F.col("put.writer").alias("commit_id"))


def state_at(graph: Graph, commit_id: int, keys: list[str] | None = None) -> DataFrame:
    """key, value, commit_id of one commit's state."""
    return states(graph, graph.places([commit_id]).withColumnRenamed("commit_id", "id"), keys).drop("id")


def digest(entries: DataFrame) -> DataFrame:
    """id, root: a digest of each state, equal for equal states; points without entries have none.

    Sums of the entries' hashes, in four parts: no state is ever gathered in one row.
    """
    one = F.sha2(F.concat_ws("\u0000", "key", "value"), 256)
    parts = [F.sum(F.conv(F.substring(one, 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return entries.groupBy("id").agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("root"))


def column_of(key: str, keys: list[str]) -> str:
    """Name of the column that holds a key's value in ``commit_states``."""
    return f"__state_{keys.index(key)}"


def _last(c: Column, w: Window) -> Column:
    return F.last(c, ignorenulls=True).over(w)


def commit_states(graph: Graph, keys: list[str]) -> DataFrame:
    """All commits with their values of some keys, one column for each; null where never put.

    One pass over the lanes: the last put within a chunk, else the last of earlier chunks, else what
    the lane began with.
    """
    if not keys:
        return graph.commits
    names = [column_of(k, keys) for k in keys]
    puts = graph.ops.filter(F.col("key").isin(keys)).groupBy("lane", "pos")
    mine = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("op_seq")))
    puts = puts.agg(*(mine(k).alias(n) for k, n in zip(keys, names, strict=True)))
    chunk = F.floor(F.col("pos") / CHUNK).alias("chunk")
    rows = graph.commits.join(puts, ["lane", "pos"], "left").select("*", chunk)
    upto = Window.partitionBy("lane", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({n: _last(F.col(n), upto) for n in names})
    tails = puts.select("*", chunk).groupBy("lane", "chunk").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("pos"))).alias(f"{n}_tail") for n in names))
    heads = rows.select("lane", "chunk").distinct().join(tails, ["lane", "chunk"], "left")
    earlier = Window.partitionBy("lane").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select("lane", "chunk", *(_last(F.col(f"{n}_tail"), earlier).alias(f"{n}_carried") for n in names))
    forks = graph.lanes.filter("fork_lane is not null").select(F.col("lane").alias("id"), F.col("fork_lane").alias("lane"), F.col("fork_pos").alias("pos"))
    begun = states(graph, forks, keys).groupBy(F.col("id").alias("lane"))
    begun = begun.agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"{n}_begun") for k, n in zip(keys, names, strict=True)))
    rows = rows.join(carried, ["lane", "chunk"], "left").join(begun, "lane", "left")
    full = {n: F.coalesce(n, f"{n}_carried", f"{n}_begun") for n in names}
    return rows.withColumns(full).select(*graph.commits.columns, *names)


def diff(graph: Graph, left: int, right: int, path: str | None = None) -> DataFrame:
    """op (+, - or ~), key, left, right: how the right commit's state differs, in order of key.

    With a path, only that key and those below it.
    """
    side = lambda c, n: state_at(graph, c).select("key", F.col("value").alias(n))
    both = side(left, "left").join(side(right, "right"), "key", "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))
    if path is not None:
        both = both.filter((F.col("key") == path) | F.startswith("key", F.lit(f"{path}.")))
    op = F.when(F.col("left").isNull(), "+").when(F.col("right").isNull(), "-").otherwise("~")
    return both.select(op.alias("op"), "key", "left", "right").orderBy("key")


def replay(chain: DataFrame, ops: DataFrame) -> DataFrame:
    """key, value after all puts of a chain: rows (step, commit_id), step 0 the newest."""
    return ops.join(chain, "commit_id").groupBy("key").agg(F.max_by("value", F.struct(-F.col("step"), F.col("op_seq"))).alias("value"))
