"""Small files and folders on whatever file system a path names, through Hadoop's client."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of small text files; used for commit logs and guard records only."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        self._context = None

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def qualified(self) -> str:
        """The folder's path with scheme, as Spark names the files in it."""
        return self._fs.makeQualified(self._at("")).toString()

    def names(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a file that is seen whole or not at all; fail if it exists."""
        temporary = self._at(f".{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if self._context is None:
            self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                self._at("").toUri(), self._conf
            )
            kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
            self._no_options = self._jvm.java.lang.reflect.Array.newInstance(kind, 0)
        try:
            self._context.rename(temporary, self._at(name), self._no_options)
        except Exception as e:
            self._fs.delete(temporary, False)
            if self._fs.exists(self._at(name)):
                raise FileExistsError(f"{self.path}/{name} exists: another writer was faster") from e
            raise

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def move(self, name: str, onto: str) -> None:
        """Rename an entry; ``onto`` must not be there."""
        if not self._fs.rename(self._at(name), self._at(onto)):
            raise OSError(f"could not rename {self.path}/{name} to {onto}")

    def usage(self) -> tuple[int, int]:
        """Number and total size of the parquet files in the folder."""
        files = [s for s in self._fs.listStatus(self._at("")) if s.getPath().getName().endswith(".parquet")]
        return len(files), sum(s.getLen() for s in files)
