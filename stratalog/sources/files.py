"""Small text files in whatever store Spark reads, by Hadoop's file systems. Run files themselves are written by Spark."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{name}" if name else self._root)

    def url(self, name: str) -> str:
        return f"{self._root}/{name}"

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        source = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def create(self, name: str, text: str) -> None:
        """The file appears whole or not at all; one that exists is an error."""
        if self._fs.exists(self._path(name)):
            raise FileExistsError(self.url(name))
        part = self._path(f"{name}.tmp")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(part, self._path(name)):
            raise FileExistsError(self.url(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def move(self, name: str, to: str) -> None:
        self._fs.mkdirs(self._path(to).getParent())
        self._fs.rename(self._path(name), self._path(to))


def scratch(spark: SparkSession) -> str:
    """A new folder for a store that lasts as long as the driver, in the folder that spark.checkpoint.dir names; without that setting in local mode alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="stratalog-")
    path = f"{at.rstrip('/')}/store-{uuid.uuid4().hex}"
    atexit.register(_drop, Files(spark, path))
    return path


def _drop(files: Files) -> None:
    with suppress(Exception):  # the session may be gone
        files.delete("")
