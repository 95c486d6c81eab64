"""Intermediate tables: small ones held by the driver, others in the shared folder.

The folder is named by ``spark.checkpoint.dir``.  A table written there cuts the lineage: a lost
executor costs only the tasks it ran.  The setting is read from the session; only a local session
without one, as in tests, gets a temporary folder.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a table is kept in the plan itself; one row more is all that is ever fetched.
SMALL = 4096

_written: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share for intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return str(spark.sparkContext.getCheckpointDir())


def temporary(spark: SparkSession) -> str:
    """A path in the shared folder that is deleted with the intermediate tables."""
    path = f"{folder(spark)}/palimpsest/{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame, **options: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back."""
    path = temporary(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """The same rows without their lineage: in the plan if there are at most ``SMALL``, else written."""
    rows = df.limit(SMALL + 1).toArrow()
    if rows.num_rows <= SMALL:
        return df.sparkSession.createDataFrame(rows, df.schema)
    return written(df)


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    names = {x.split("/")[-2] for table in tables for x in table.inputFiles()}
    for path in [x for x in _written if x.split("/")[-1] in names]:
        _delete(path)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end the tables that were written in it; frames made inside must be read inside."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [x for x in _written if x not in before]:
            _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    with contextlib.suppress(Exception):
        sc = spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def clear() -> None:
    """Deletes the tables written so far; frames that still read them fail afterwards."""
    for path in list(_written):
        _delete(path)
