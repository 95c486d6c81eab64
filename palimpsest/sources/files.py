"""Small text files in any file system that Spark reaches."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession


class Files:
    """Text files under one folder; writes replace a file in one step."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str) -> tuple[Any, Any]:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)  # type: ignore[union-attr]
        return path.getFileSystem(sc._jsc.hadoopConfiguration()), path

    def exists(self, name: str = "") -> bool:
        system, path = self._at(name)
        return bool(system.exists(path))

    def make_folder(self, name: str) -> None:
        system, path = self._at(name)
        system.mkdirs(path)

    def names(self, folder: str) -> list[str]:
        """Names of the files in a folder, in order."""
        system, path = self._at(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(path) if s.isFile()) if system.exists(path) else []

    def read(self, name: str) -> str:
        system, path = self._at(name)
        stream = system.open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        _, path = self._at(name)
        system, beside = self._at(f"{name}.{uuid.uuid4().hex}.new")
        stream = system.create(beside, True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        self._replace(beside, path)

    def _replace(self, old: Any, new: Any) -> None:
        """Renames in one step: a reader finds the file before or the file after."""
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs  # type: ignore[union-attr]
        option = getattr(hadoop, "Options$Rename")
        options = sc._gateway.new_array(option, 1)  # type: ignore[union-attr]
        options[0] = option.OVERWRITE
        context = hadoop.FileContext.getFileContext(new.toUri(), sc._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(old), context.makeQualified(new), options)

    def delete_folder(self, name: str) -> None:
        system, path = self._at(name)
        system.delete(path, True)
