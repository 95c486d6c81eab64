"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source's share of the total size is proportional to its weight but at most ``max_repeats`` times
its own size; what it can't take is shared among the others by weight.  Within a source the documents
are put in order of size, their expected copies (target / source size) are summed up in that order,
and a document is taken once for each integer that the sum, plus one offset of the source, passes.
In an order by size the words taken differ from the target by the largest document at most.

The running sum of a source is computed in two steps, so that no source is ever sorted in one task:
documents are counted by (size class, hash bucket), the counts are summed in that order, and the
place within a bucket is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 17


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size and target of each source, given (source, size) rows.

    Sources by code point, null last, have the given weights in turn.  With the sources in order of
    size over weight, the level at which the i-th would be filled is what the sources before leave,
    over the weights from it on; the largest of these is the level of all sources below their cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = per.withColumn("weight", turn).withColumn("cap", max_repeats * F.col("source_size"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filling), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0))
    level = F.max("level").over(everything)
    leveled = weighed.withColumn("level", left.cast("double") / weight_left.cast("double"))
    target = F.least(F.col("cap").cast("double"), level * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def sampled(
    docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED
) -> DataFrame:
    """The rows with columns size, source_size, target and copies added, each row once.

    A row of null size counts as 0.  Rows of a source whose sizes are all 0 get no copies.  A null
    source is a source of its own, the last.  Equal rows are taken in any order; a run over the same
    rows gives the same copies.  A column that has the name of an added one is replaced; an empty
    table gives an empty result.
    """
    names = docs.columns
    own = {n: f"__c{i}" for i, n in enumerate(names)}
    bits = F.length(F.bin("size"))
    size_class = 32 * bits + F.expr("shiftright(size, cast(greatest(length(bin(size)) - 5, 0) as int))")
    named = docs.select(*(F.col(f"`{n}`").alias(c) for n, c in own.items()), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    key = own[key]
    placed = named.withColumns({"__source": F.col(own[source]).cast("string"), "__class": size_class, "__bucket": _hex(F.coalesce(F.col(key).cast("string"), F.lit("")), 2)})
    goal = targets(placed.select(F.col("__source").alias("source"), "size"), weights, max_repeats)
    group = ["__source", "__class", "__bucket"]
    before = Window.partitionBy("__source").orderBy("__class", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*group).agg(F.count("*").alias("n"))
    counts = counts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    starts = counts.join(goal.withColumnRenamed("source", "__g"), F.col("__source").eqNullSafe(F.col("__g"))).drop("__g")
    starts = starts.select(*(F.col(c).alias(f"{c}_") for c in group), "__before", "source_size", "target")
    within = F.row_number().over(Window.partitionBy(*group).orderBy("size", key))
    ranked = placed.withColumn("__within", within).join(
        starts, F.col("__source").eqNullSafe(F.col("__source_")) & (F.col("__class") == F.col("__class_")) & (F.col("__bucket") == F.col("__bucket_"))
    )
    offset = _hex(F.concat(F.lit(f"{seed}|"), F.coalesce("__source", F.lit(""))), 5) / F.lit(1048576.0)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    rank = F.col("__before") + F.col("__within")
    upto = lambda r: F.floor(F.col("__share") * r.cast("double") + F.col("__offset"))
    counted = ranked.withColumns({"__share": share, "__offset": offset, "__rank": rank})
    copies = F.least(upto(F.col("__rank")) - upto(F.col("__rank") - 1), F.lit(max_repeats)).cast("long")
    added = ("size", "source_size", "target", "copies")
    return counted.withColumn("copies", copies).select(*(F.col(c).alias(n) for n, c in own.items() if n not in added), *added)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options: object) -> DataFrame:
    """The documents, each as often as it is taken, with the columns they came with."""
    names = docs.columns
    marked = docs.select(*(F.col(f"`{n}`").alias(f"__c{i}") for i, n in enumerate(names)))
    at = {n: f"__c{i}" for i, n in enumerate(names)}
    taken = sampled(marked, word_count(F.col(at[text])), at[source], at[key], **options).filter("copies > 0")  # type: ignore[arg-type]
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col(at[n]).alias(n) for n in names))


#: The result of ``sampled`` over documents, for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM p
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM w WINDOW f AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight::DOUBLE) AS target,
    ('0x' || substr(md5('17|' || coalesce(source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS off FROM l
), k AS (
  SELECT *, 32 * length(bin(size)) + (size >> greatest(length(bin(size)) - 5, 0)) AS cls,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2))::BIGINT AS bucket FROM d
), r AS (
  SELECT k.*, source_size, target, off, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS share,
    row_number() OVER (PARTITION BY k.source ORDER BY cls, bucket, size, doc_id NULLS FIRST)::DOUBLE AS rank
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, least(floor(share * rank + off) - floor(share * (rank - 1) + off), 3)::BIGINT AS copies FROM r
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
