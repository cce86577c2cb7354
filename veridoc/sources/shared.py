"""Tables that jobs write to shared storage and read again, so that costly steps run once; and small files beside
them, by the file system that Spark itself uses."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset it is a temporary one if driver and executors
    are one process, and an error otherwise."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'veridoc-shared')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to shared storage and read back."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Names, creates and deletes small files of a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.gateway, self.conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, in order; none if there is no such folder."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Creates a whole file at once; raises FileExistsError if there is one of that name already."""
        draft = self._path(f"{name}.{uuid.uuid4().hex[:12]}.tmp")
        stream = self.fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        never = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(name), never)
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise FileExistsError(f"{self.root}/{name}") from None
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
