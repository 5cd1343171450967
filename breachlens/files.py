"""Small files by the file system that Spark itself uses."""

import uuid

from pyspark.sql import SparkSession


class Files:
    """The few file operations that are no job."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(self._conf)

    def path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return [status.getPath().getName() for status in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def exists(self, path: str) -> bool:
        return self._fs.exists(self.path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self.path(path), True)

    def read(self, path: str) -> str:
        stream = self._fs.open(self.path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def first_line(self, path: str) -> str:
        """The first line that is not blank, decompressed by the file's ending; empty if there is none."""
        found = self.path(path)
        stream = found.getFileSystem(self._conf).open(found)
        try:
            codec = self._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(self._conf).getCodec(found)
            opened = stream if codec is None else codec.createInputStream(stream)
            reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(opened, "UTF-8"))
            line = reader.readLine()
            while line is not None and not line.strip():
                line = reader.readLine()
            return line or ""
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self._fs.create(self.path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Create a file with that text in one step; False if there is one already."""
        folder, _, name = path.rpartition("/")
        beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.write(beside, text)
        target = self.path(path)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(
            self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0
        )
        try:
            context.rename(self._fs.makeQualified(self.path(beside)), self._fs.makeQualified(target), none)
        except Exception:
            taken = self._fs.exists(target)
            self.delete(beside)
            if taken:
                return False
            raise
        return True
