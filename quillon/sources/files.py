"""Small files beside the tables, through Hadoop's file systems, so that a catalog can be wherever Spark can read."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def age(self, path: str) -> float:
        """Seconds since a file or folder was last changed."""
        fs, p = self._at(path)
        return (self.jvm.System.currentTimeMillis() - fs.getFileStatus(p).getModificationTime()) / 1000

    def create(self, path: str, text: str) -> bool:
        """Write a new file whole, or not at all; False if there is one already. The text is written aside and put in place by one step of
        the file system that fails where a file stands: a hard link on local disks, a rename without overwriting elsewhere."""
        aside = f"{path}.{uuid.uuid4().hex}.tmp"
        fs, temporary = self._at(aside)
        out = fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        try:
            if fs.getScheme() == "file":
                file = self.jvm.java.io.File
                self.jvm.java.nio.file.Files.createLink(file(target.toUri().getPath()).toPath(), file(temporary.toUri().getPath()).toPath())
            else:
                rename = self.jvm.org.apache.hadoop.fs.Options.Rename
                none = self.spark.sparkContext._gateway.new_array(rename, 1)
                none[0] = getattr(rename, "NONE")
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(temporary), fs.makeQualified(target), none)
            return True
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        finally:
            fs.delete(temporary, False)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
