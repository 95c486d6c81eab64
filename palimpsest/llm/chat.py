"""Chat formatting by perspective rotation: each participant in turn is the assistant.

For every participant of a conversation the whole dialogue is rendered once: that speaker's turns as
the assistant's, all others as named users, system turns as they are.  The loss mask covers the content
and end mark of the assistant's turns.  The result has one row for each turn of a rendering with its
place in it, so a conversation of any length is never held in one row or task; a rendering's text is
its segments in order of ``start``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation are put in order in chunks of so many turn numbers.
CHUNK = 256
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What begins a mark, and what stands for it where a text or name has it: no text can forge a turn.
MARK, ESCAPED = "<|im_", "<| im_"


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = SYSTEM) -> DataFrame:
    """conv_id, perspective, position, turn, role, name, segment, start, mask_start, mask_end.

    position counts the turns of a rendering from 0, in order of turn, speaker and text, nulls last;
    repeated rows stay.  role is assistant, user or system; name the speaker of a user's turn.
    segment is the rendered turn, start its place in the rendering; characters of the rendering from
    mask_start up to mask_end are trained on (both null for others' turns).  Places count code points.
    Marks inside texts and names are written with a blank, line breaks in names as one.
    A null text is empty; a null speaker is a participant named "unknown"; a null conversation is a
    conversation of its own.  A conversation without participants, of system turns alone, has no
    rendering.  Other columns take no part; an empty table gives an empty result.
    """
    rows = turns.select(
        F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{speaker}`"), F.lit("unknown")).alias("speaker"), F.replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(MARK), F.lit(ESCAPED)).alias("text"),
    )
    participants = rows.filter(F.col("speaker") != system).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(participants, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    seen = seen.withColumn("role", F.when(F.col("speaker") == system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user")))
    seen = seen.withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    shown = F.replace(F.replace("name", F.lit(MARK), F.lit(ESCAPED)), F.lit("\n"), F.lit(" "))
    head = F.concat(F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" name="), shown), F.lit("")), F.lit("\n"))
    seen = seen.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "text", F.lit(CLOSE)))
    seen = seen.withColumn("n", F.length("segment").cast("long")).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    group = ["conv_id", "perspective", "chunk"]
    totals = seen.groupBy(*group).agg(F.sum("n").alias("chars"), F.count("*").alias("turns"))
    before = Window.partitionBy("conv_id", "perspective").orderBy(F.col("chunk").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(g).alias(f"{g}_") for g in group), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"))
    within = Window.partitionBy(*group).orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    sums = F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = seen.withColumns({"inner": sums, "at": F.row_number().over(within) - 1})
    placed = placed.join(totals, F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("perspective") == F.col("perspective_")) & F.col("chunk").eqNullSafe(F.col("chunk_")))
    placed = placed.withColumns({"start": F.col("chars_before") + F.col("inner"), "position": F.col("turns_before") + F.col("at")})
    trained = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "position", "turn", "role", "name", "segment", "start",
        F.when(trained, F.col("start") + F.col("head")).alias("mask_start"), F.when(trained, F.col("start") + F.col("n") - 1).alias("mask_end"),
    )


#: The result of ``rotate`` over conversations, for DuckDB.
SQL = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id AS c, speaker AS perspective FROM r WHERE speaker <> 'system'
), s AS (
  SELECT conv_id, perspective, turn, speaker, text,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM r JOIN p ON conv_id IS NOT DISTINCT FROM c
), h AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
    '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || replace(replace(speaker, '<|im_', '<| im_'), chr(10), ' ') ELSE '' END || chr(10) AS head FROM s
), g AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h
), o AS (
  SELECT *, row_number() OVER w - 1 AS position, (sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT - length(segment) AS start
  FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text)
)
SELECT conv_id, perspective, position, turn, role, name, segment, start,
  CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN start + length(segment) - 1 END AS mask_end
FROM o
"""
