"""Path indexes: for each commit, from an indexed value to the primary key of the document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.graph import Graph
from palimpsest.operators.state import column_of, commit_states, state_at
from palimpsest.sources.schema import Registry

#: Between the fields of a primary key.
SEPARATOR = "\u001f"


def entries(graph: Graph, registry: Registry) -> DataFrame:
    """commit_id, index_name, key, pk: what each index holds at each commit.

    An entry needs the indexed value and all fields of the primary key in the commit's state; an old
    value's entry is gone once the value changes.
    """
    wanted = registry.indexes()
    keys = sorted({i.path for _, i in wanted} | {path for c, _ in wanted for path, _ in c.keys})
    empty = graph.spark.createDataFrame([], "commit_id long, index_name string, key string, pk string")
    if not keys:
        return empty
    rows = commit_states(graph, keys)
    at = lambda path: F.col(column_of(path, keys))
    one = []
    for collection, index in wanted:
        fields = [at(path) for path, _ in collection.keys]
        whole = reduce(lambda a, b: a & b, (f.isNotNull() for f in fields), at(index.path).isNotNull())
        one.append(F.when(whole, F.struct(F.lit(index.name).alias("index_name"), at(index.path).alias("key"), F.concat_ws(SEPARATOR, *fields).alias("pk"))))
    held = rows.select("commit_id", F.explode(F.array_compact(F.array(*one))).alias("e"))
    return held.select("commit_id", "e.index_name", "e.key", "e.pk")


def lookup(graph: Graph, registry: Registry, commit_id: int, index_name: str, key: str) -> DataFrame:
    """pk of the document that has a value in an index of a commit; reads that commit's state only."""
    found = [(c, i) for c, i in registry.indexes() if i.name == index_name]
    empty = graph.spark.createDataFrame([], "pk string")
    if not found:
        return empty
    collection, index = found[0]
    fields = [path for path, _ in collection.keys]
    held = state_at(graph, commit_id, sorted({index.path, *fields}))
    value = lambda path: F.max(F.when(F.col("key") == path, F.col("value")))
    row = held.groupBy().agg(value(index.path).alias("at"), *(value(f).alias(f"f{i}") for i, f in enumerate(fields)))
    whole = reduce(lambda a, b: a & b, (F.col(f"f{i}").isNotNull() for i in range(len(fields))), F.col("at") == key)
    return row.filter(whole).select(F.concat_ws(SEPARATOR, *(f"f{i}" for i in range(len(fields)))).alias("pk"))
