"""The few file operations a table needs, on whatever file system Spark can reach."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class AlreadyThere(RuntimeError):
    """Another writer has created the file."""


class Files:
    def __init__(self, spark: SparkSession, home: str) -> None:
        self._jvm = spark._jvm
        self.home = home.rstrip("/")
        self._fs = self._path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def walk(self, folder: str) -> list[tuple[str, int, int]]:
        """(path, bytes, modified in ms) of all files below."""
        out = []
        if self.exists(folder):
            it = self._fs.listFiles(self._path(folder), True)
            while it.hasNext():
                s = it.next()
                out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(out)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Writes a file that isn't there yet; AlreadyThere if it is. The text is written aside first, so that no
        reader meets half of it, and takes its name in one step that never replaces."""
        target = self._path(path)
        aside = self._path(f"{self.home}/_aside/{self._jvm.java.util.UUID.randomUUID()}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        self._fs.mkdirs(target.getParent())
        try:
            options = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
            none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            options.rename(aside, target, none)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise AlreadyThere(path) from e
            raise

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
