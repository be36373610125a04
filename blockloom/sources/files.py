"""Small files in the shared folder, by Hadoop's file systems: what Spark can reach, this reaches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of a few small files and of tables written by Spark."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder below; nothing if it isn't there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def lengths(self, name: str) -> dict[str, int]:
        """Files of a folder below and their lengths."""
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._at(name)) if s.isFile()} if self.exists(name) else {}

    def read(self, name: str):
        """A JSON file's value; None if it isn't there."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def replace(self, name: str, value) -> None:
        """Writes a JSON file beside its place and moves it there: readers see the old one or the new one."""
        fresh = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._at(fresh), True)
        try:
            stream.write(json.dumps(value, sort_keys=True).encode())
        finally:
            stream.close()
        kind = self._jvm.org.apache.hadoop.fs
        kinds = self.spark.sparkContext._gateway.new_array(kind.Options.Rename, 1)
        kinds[0] = getattr(kind, "Options$Rename").OVERWRITE
        kind.FileContext.getFileContext(self._at("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self._at(fresh), self._at(name), kinds)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
