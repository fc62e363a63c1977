"""Files and folders through Hadoop's file systems, so that any store works that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def fs(self, path: str):
        return self.path(path).getFileSystem(self.conf)

    def full(self, path: str) -> str:
        """The path with its scheme, for comparing."""
        return str(self.fs(path).makeQualified(self.path(path)).toString()).rstrip("/")

    def exists(self, path: str) -> bool:
        return self.fs(path).exists(self.path(path))

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no folder."""
        if not self.exists(path):
            return []
        return sorted(x.getPath().getName() for x in self.fs(path).listStatus(self.path(path)))

    def make(self, path: str) -> None:
        self.fs(path).mkdirs(self.path(path))

    def write(self, path: str, data: bytes) -> None:
        """A small file, visible only when it is whole."""
        folder, _, name = path.rpartition("/")
        part = f"{folder}/_part_{uuid.uuid4().hex}_{name}"
        out = self.fs(path).create(self.path(part), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        self.move(part, path)

    def read(self, path: str) -> str:
        """A small file's text."""
        stream = self.fs(path).open(self.path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def forget_at_exit(self, path: str) -> None:
        """Remove the path when the session's JVM ends."""
        self.fs(path).deleteOnExit(self.path(path))

    def remove(self, path: str) -> None:
        self.fs(path).delete(self.path(path), True)

    def move(self, source: str, target: str) -> None:
        if not self.fs(source).rename(self.path(source), self.path(target)):
            raise OSError(f"can't move {source} to {target}")
