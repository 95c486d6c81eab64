"""A Spark session for command-line use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session() -> SparkSession:
    """The active session, or a local one sized for interactive use."""
    if active := SparkSession.getActiveSession():
        return active
    builder = SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
