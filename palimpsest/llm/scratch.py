"""Intermediate tables of the corpus operators, and this package for their Python workers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from palimpsest import shared

_shipped: set[str] = set()
#: Rows that go to a Python worker at once, where the session leaves Spark's default: whole texts are long.
ROWS_AT_ONCE, SPARK_DEFAULT = "1000", "10000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Once per application, gives the executors' Python workers the modules of this subpackage.

    Where the session leaves Spark's default number of rows that go to a worker at once, it is lowered:
    the operators' results are computed after they return, so this holds for the whole session.
    """
    if spark.conf.get(_BATCH, SPARK_DEFAULT) == SPARK_DEFAULT:
        spark.conf.set(_BATCH, ROWS_AT_ONCE)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="palimpsest-"), "palimpsest_workers.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in [top / "__init__.py", top / "shared.py", *sorted((top / "llm").glob("*.py"))]:
            z.write(path, path.relative_to(top.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this subpackage."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def _files_of_one_write(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each ends: nothing reads their plans again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once and read back; disk holds one step's shuffle files and not those of all."""
    with _files_of_one_write(df.sparkSession):
        return shared.written(df, compression="zstd")


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    shared.release(*tables)
