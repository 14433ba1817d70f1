"""Small files and folders on whatever file system Spark writes to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master may go without the setting: it then gets a folder of its own,
    which goes with the process.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"set {key} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="veldspar-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(key, f"file://{folder}")
    return f"file://{folder}"


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces the file; readers see the old or the new text, never a part."""
        attempt = self._path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(attempt)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(attempt.toUri(), self.conf) if attempt.toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        self.jvm.java.lang.reflect.Array.set(options, 0, getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE)
        context.rename(self.fs.makeQualified(attempt), self.fs.makeQualified(self._path(name)), options)

    def create(self, name: str, text: str) -> bool:
        """Writes a file that isn't there, as a whole; False if it is. Of several writers one
        succeeds, on file systems whose rename doesn't replace (HDFS) and on local ones."""
        attempt, target = self._path(f"{name}.{uuid.uuid4().hex}"), self._path(name)
        if self.fs.exists(target):
            return False
        stream = self.fs.create(attempt)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                link = lambda p: p.toUri().getPath()
                os.link(link(attempt), link(target))
                return True
            options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(attempt), self.fs.makeQualified(target), options)
            return True
        except (FileExistsError, Py4JJavaError):
            if self.fs.exists(target):
                return False
            raise
        finally:
            self.fs.delete(attempt, False)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str = "") -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self._path(name), True)
