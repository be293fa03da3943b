"""Small files of a table on any file system that Spark's Hadoop layer reaches.

There is no public Python interface to that layer, so this goes through the session's gateway to the JVM.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Files of one folder. A file appears whole or not at all: it is written beside, synced and renamed."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path(folder).getFileSystem(conf)
        self.folder = self._fs.makeQualified(self._path(folder)).toString().rstrip("/")
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), conf)
        self._over = spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._over[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def make(self) -> None:
        self._fs.mkdirs(self._path(self.folder))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, prefix: str, inside: str = "") -> list[str]:
        """Sorted names of what stands in the folder, or in one inside it."""
        folder = self._path(self.at(inside) if inside else self.folder)
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return sorted(n for f in found if (n := f.getPath().getName()).startswith(prefix))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        beside = f"_{name}-{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(self.at(beside)), False)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()
        self.rename(beside, name)

    def rename(self, name: str, to: str) -> None:
        self._context.rename(self._path(self.at(name)), self._path(self.at(to)), self._over)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)
