"""A stream of changes appended to a repository, one commit for each document and batch.

A batch's changes and its branches go from the stream to the tables without passing the driver.  Each
document is a branch, made by its first change.  A batch is written to a folder of its own and becomes
visible, with its number and the next ids, when the repository's metadata is replaced: one that failed
half way left nothing to see and runs again, one that was stored is recognised by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from palimpsest.shared import settle
from palimpsest.sources.repository import Repository

#: Tasks that number a batch's documents.
PARTS = 16


def append_batch(repo: Repository, batch: DataFrame, number: int) -> None:
    """Adds one commit to each document's branch that a batch changes.

    ``batch`` has document, key, value and at (the order of changes of one key within a document).
    """
    if repo.streamed >= number:
        return
    before = repo.state()
    try:
        _append(repo, batch, number)
    except BaseException:
        repo.restore(before)
        raise


def _append(repo: Repository, batch: DataFrame, number: int) -> None:
    repo.flush()
    graph = repo.graph()
    head = repo.head()[1]
    tips = graph.refs.join(graph.commits.select("commit_id", "hash", "lane", "pos"), "commit_id")
    old = tips.select(F.col("name").alias("document"), *(F.col(c).alias(f"tip_{c}") for c in ("commit_id", "hash", "lane", "pos")))
    first_id, first_lane = repo.reserve(PARTS << 33)  # what monotonically_increasing_id may give
    pick = lambda c: F.coalesce(f"tip_{c}", F.lit(getattr(head, c)))
    # a commit goes on its tip's lane if nothing else has, and no other document of the batch does
    tops = graph.commits.groupBy(F.col("lane").alias("tip_lane")).agg(F.max("pos").alias("tip_pos"), F.lit(True).alias("top"))
    named = batch.select("document").distinct().join(old, "document", "left")
    one = named.filter("tip_commit_id is not null").groupBy("tip_commit_id").agg(F.min("document").alias("document")).withColumn("one", F.lit(True))
    named = named.join(tops, ["tip_lane", "tip_pos"], "left").join(one, ["tip_commit_id", "document"], "left")
    named = named.repartition(PARTS, "document").withColumn("i", F.monotonically_increasing_id())
    onward = F.coalesce(F.col("top") & F.col("one"), F.lit(False))
    new = settle(named.select(
        "document", (F.col("i") + first_id).alias("commit_id"), F.sha2(F.concat_ws("|", F.lit("stream"), F.lit(number), "document", pick("hash")), 256).alias("hash"),
        F.lit(number).cast("long").alias("ts"), F.concat(F.lit("batch "), F.lit(number)).alias("message"), pick("commit_id").alias("state_base"),
        F.when(onward, F.col("tip_lane")).otherwise(F.col("i") + first_lane).alias("lane"), (pick("pos") + 1).alias("pos"),
        F.when(~onward, pick("lane")).alias("fork_lane"), F.when(~onward, pick("pos")).alias("fork_pos"),
    ))
    puts = batch.groupBy("document", "key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    by = Window.partitionBy("document").orderBy("at", "key")
    ops = puts.withColumn("op_seq", (F.row_number().over(by) - 1).cast("int")).join(new, "document")
    forks = new.filter("fork_lane is not null")
    cross = forks.select(F.col("lane").alias("c_lane"), F.col("pos").alias("c_pos"), F.col("fork_lane").alias("p_lane"), F.col("fork_pos").alias("p_pos"), F.lit(0).alias("ordinal"))
    rows = {
        "commits": new, "ops": ops, "cross": cross, "lanes": forks,
        "edges": new.select(F.col("commit_id").alias("child"), F.col("state_base").alias("parent"), F.lit(0).alias("ordinal")),
    }
    rows["refs"] = new.select(F.col("document").alias("name"), "commit_id", F.lit(number).cast("long").alias("version"))
    repo.stage(rows)
    # branches of the metadata come before those of the table: the few that the batch moves
    moved = new.filter(F.col("document").isin(list(repo.branches))).select("document", "commit_id").collect()
    repo.branches |= {r["document"]: r["commit_id"] for r in moved}
    repo.streamed = number
    repo.forget_lanes()
    repo.flush()


def append_stream(repo: Repository, changes: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts appending a stream of changes; ``once`` stops after what is there now."""
    writer = changes.writeStream.foreachBatch(lambda batch, number: append_batch(repo, batch, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
