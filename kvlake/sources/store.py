"""Files through Hadoop's file system, and intermediate tables in the folder that all nodes share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether the executors are threads of the driver."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, one of our own, which only a local master (tests) can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kvlake-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def saved(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and its path: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/kvlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Files:
    """The few file operations the engine needs, on any file system Hadoop reaches."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> None:
        """A new file that appears whole or not at all: written beside, then renamed. An existing file is an error."""
        fs, p = self._at(path)
        folder, _, name = path.rpartition("/")
        _, beside = self._at(f"{folder}/.{name}.{uuid.uuid4().hex}.tmp")
        out = fs.create(beside, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if fs.exists(p) or not fs.rename(beside, p):
            fs.delete(beside, False)
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)
