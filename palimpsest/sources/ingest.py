"""Commit graphs made of tables: one chain of commits for each user or conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.graph import Graph

GENESIS = "genesis"
#: Users are merged in so many groups.
GROUPS = 5


def _sha(*parts: object) -> F.Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def _genesis(spark: SparkSession) -> DataFrame:
    row = spark.range(1).select(F.lit(0).cast("long").alias("commit_id"), F.sha2(F.lit(GENESIS), 256).alias("hash"), F.lit(0).cast("long").alias("ts"), F.lit(GENESIS).alias("message"))
    return row.select("*", F.lit(None).cast("long").alias("state_base"), F.lit(0).cast("long").alias("lane"), F.lit(0).cast("long").alias("pos"))


def _chains(spark: SparkSession, rows: DataFrame, prefix: str) -> Graph:
    """``rows`` has chain, at (its order), commit_id, hash, ts, message and puts (key to value)."""
    pos = F.row_number().over(Window.partitionBy("chain").orderBy("at", "commit_id")).cast("long")
    # the previous commit of each chain, the genesis before the first
    base = F.coalesce(F.lag("commit_id").over(Window.partitionBy("chain").orderBy("at", "commit_id")), F.lit(0).cast("long"))
    placed = rows.withColumns({"pos": pos, "state_base": base, "lane": F.col("chain") + 1})
    commits = _genesis(spark).unionByName(placed.select("commit_id", "hash", "ts", "message", "state_base", "lane", "pos"))
    edges = placed.select(F.col("commit_id").alias("child"), F.col("state_base").alias("parent"), F.lit(0).alias("ordinal"))
    ops = placed.select("commit_id", "lane", "pos", F.posexplode("puts").alias("op_seq", "put")).select("commit_id", "lane", "pos", "op_seq", "put.key", "put.value")
    chains = rows.select("chain").distinct()
    zero = F.lit(0).cast("long")
    lanes = chains.select((F.col("chain") + 1).alias("lane"), zero.alias("fork_lane"), zero.alias("fork_pos"))
    lanes = lanes.unionByName(spark.range(1).select(F.col("id").alias("lane"), F.lit(None).cast("long").alias("fork_lane"), F.lit(None).cast("long").alias("fork_pos")))
    cross = chains.select((F.col("chain") + 1).alias("c_lane"), F.lit(1).cast("long").alias("c_pos"), zero.alias("p_lane"), zero.alias("p_pos"), F.lit(0).alias("ordinal"))
    tips = placed.groupBy("chain").agg(F.max_by("commit_id", "pos").alias("commit_id"))
    refs = tips.select(F.concat(F.lit(prefix), "chain").alias("name"), "commit_id").unionByName(spark.range(1).select(F.lit("main").alias("name"), F.col("id").alias("commit_id")))
    return Graph(spark, commits, edges, ops, lanes, cross, refs, "main")


def _puts(**values: F.Column) -> F.Column:
    return F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()))


def events(spark: SparkSession, sf_dir: str) -> Graph:
    """One commit for each event after the user's previous one; branch u<user_id> at the last."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    puts = F.concat(
        _puts(event_type=kind, value=F.col("value").cast("decimal(18,2)").cast("string"), **{"props.k": F.get_json_object("props", "$.k")}),
        F.array(F.struct(F.concat(F.lit("last."), kind).alias("key"), F.col("event_id").cast("string").alias("value"))),
    )
    rows = table.select(
        F.col("user_id").alias("chain"), F.col("ts").alias("at"), (F.col("event_id") + 1).alias("commit_id"), _sha(F.lit("ev"), "event_id").alias("hash"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("event "), "event_id").alias("message"), puts.alias("puts"),
    )
    return _chains(spark, rows, "u")


def conversations(spark: SparkSession, sf_dir: str) -> Graph:
    """One commit for each turn after the one before; branch conv<conv_id> at the last."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = table.select(
        F.col("conv_id").alias("chain"), F.col("turn").alias("at"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("commit_id"), _sha(F.lit("cv"), "conv_id", "turn").alias("hash"),
        F.col("turn").alias("ts"), F.concat(F.lit("turn "), "turn").alias("message"),
        _puts(role=F.col("role"), turn=F.col("turn").cast("string"), n_chars=F.length("text").cast("string")).alias("puts"),
    )
    return _chains(spark, rows, "conv")


def merged_events(spark: SparkSession, sf_dir: str) -> Graph:
    """``events`` with a merge of all users of each remainder by five, and a merge of these on main."""
    g = events(spark, sf_dir)
    user = F.substring("name", 2, 20).try_cast("long")
    tips = g.refs.filter("name <> 'main'").select(user.alias("user"), "commit_id").withColumn("r", F.col("user") % GROUPS)
    first = 10**12
    zero = F.lit(0).cast("long")
    groups = tips.groupBy("r").agg(F.min("user").alias("user"), F.min_by("commit_id", "user").alias("state_base"))
    groups = groups.join(g.commits.select(F.col("commit_id").alias("state_base"), F.col("lane").alias("fork_lane"), F.col("pos").alias("fork_pos")), "state_base")
    merges = groups.select(
        (F.col("r") + first).alias("commit_id"), _sha(F.lit("merge"), "r").alias("hash"), zero.alias("ts"), F.concat(F.lit("merge "), "r").alias("message"), "state_base",
        (F.col("r") + first).alias("lane"), (F.col("fork_pos") + 1).alias("pos"), "fork_lane", "fork_pos", F.col("r").cast("string").alias("put"),
    )
    parents = Window.partitionBy("r").orderBy("user")
    edges = tips.select((F.col("r") + first).alias("child"), F.col("commit_id").alias("parent"), (F.row_number().over(parents) - 1).alias("ordinal"))
    # merge 0 extends into the top commit's lane: the top's first parent is merge 0
    low = merges.agg(F.min("commit_id").alias("state_base")).join(merges.select(F.col("commit_id").alias("state_base"), "lane", "pos"), "state_base")
    top = low.select(
        F.lit(first + GROUPS).cast("long").alias("commit_id"), _sha(F.lit("merge"), F.lit("top")).alias("hash"), zero.alias("ts"), F.lit("merge top").alias("message"), "state_base",
        "lane", (F.col("pos") + 1).alias("pos"), F.lit(None).cast("long").alias("fork_lane"), F.lit(None).cast("long").alias("fork_pos"), F.lit("top").alias("put"),
    )
    ordinal = F.row_number().over(Window.orderBy("commit_id")) - 1  # five rows
    edges = edges.unionByName(merges.select(F.lit(first + GROUPS).cast("long").alias("child"), F.col("commit_id").alias("parent"), ordinal.alias("ordinal")))
    new = merges.unionByName(top)
    commits = g.commits.unionByName(new.select(*g.commits.columns))
    ops = g.ops.unionByName(new.select("commit_id", "lane", "pos", F.lit(0).alias("op_seq"), F.lit("merged").alias("key"), F.col("put").alias("value")))
    place = lambda end, p: commits.select(F.col("commit_id").alias(end), F.col("lane").alias(f"{p}_lane"), F.col("pos").alias(f"{p}_pos"))
    cross = edges.join(place("child", "c"), "child").join(place("parent", "p"), "parent").filter("not (c_lane = p_lane and ordinal = 0)")
    refs = g.refs.filter("name <> 'main'").unionByName(top.select(F.lit("main").alias("name"), "commit_id"))
    return Graph(g.spark, commits, g.edges.unionByName(edges), ops, g.lanes.unionByName(merges.select("lane", "fork_lane", "fork_pos")), g.cross.unionByName(cross.select(*g.cross.columns)), refs, "main")


def deep_history(spark: SparkSession, live_keys: int, commits: int, value_bytes: int = 256) -> Graph:
    """One long chain: commit i puts key i modulo ``live_keys`` with a value of that many bytes; branch main at the last."""
    at = spark.range(1, commits + 1)
    one = F.lit(0).cast("long")
    made = at.select(
        F.col("id").alias("commit_id"), _sha(F.lit("deep"), "id").alias("hash"), F.col("id").alias("ts"), F.concat(F.lit("commit "), "id").alias("message"),
        (F.col("id") - 1).alias("state_base"), one.alias("lane"), F.col("id").alias("pos"),
    )
    value = F.rpad(F.concat(F.lit("v"), F.col("id"), F.lit("|")), value_bytes, "x")
    ops = at.select(
        F.col("id").alias("commit_id"), one.alias("lane"), F.col("id").alias("pos"), F.lit(0).alias("op_seq"), F.concat(F.lit("k/"), (F.col("id") - 1) % live_keys).alias("key"), value.alias("value")
    )
    edges = at.select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"), F.lit(0).alias("ordinal"))
    lanes = spark.range(1).select(F.col("id").alias("lane"), F.lit(None).cast("long").alias("fork_lane"), F.lit(None).cast("long").alias("fork_pos"))
    cross = lanes.select(F.col("lane").alias("c_lane"), one.alias("c_pos"), one.alias("p_lane"), one.alias("p_pos"), F.lit(0).alias("ordinal")).limit(0)
    refs = spark.range(1).select(F.lit("main").alias("name"), F.lit(commits).cast("long").alias("commit_id"))
    return Graph(spark, _genesis(spark).unionByName(made), edges, ops, lanes, cross, refs, "main")
