"""Small files on whatever store Spark reads, through its file systems."""

from __future__ import annotations

import re
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one of our own if all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tempora-store-")
    return where.rstrip("/")


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def fs(self, path):
        return path.getFileSystem(self.conf)

    def exists(self, text: str) -> bool:
        p = self.path(text)
        return self.fs(p).exists(p)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        fs = self.fs(p)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, text: str) -> str:
        p = self.path(text)
        stream = self.fs(p).open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, body: str) -> bool:
        """Write a new file whole; False if one of that name came first. Of two writers at once only one can win: a hard link
        (local) or a rename (HDFS) to a name that is taken fails, and elsewhere the store's own create does."""
        p = self.path(text)
        fs = self.fs(p)
        scheme = fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            return self._put(fs, p, body, False)
        tmp = self.path(f"{text}.{self.jvm.java.util.UUID.randomUUID().toString()}.tmp")
        self._put(fs, tmp, body, True)
        try:
            if scheme == "file":
                paths = [self.jvm.java.io.File(x.toUri().getPath()).toPath() for x in (fs.makeQualified(p), fs.makeQualified(tmp))]
                self.jvm.java.nio.file.Files.createLink(*paths)
                return True
            return not fs.exists(p) and fs.rename(tmp, p)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            fs.delete(tmp, False)

    @staticmethod
    def _put(fs, path, body: str, over: bool) -> bool:
        try:
            out = fs.create(path, over)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        return True

    def delete(self, text: str) -> None:
        p = self.path(text)
        self.fs(p).delete(p, True)

    def copy(self, source: str, target: str) -> None:
        a, b = self.path(source), self.path(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs(a), a, self.fs(b), b, False, self.conf)
