"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests in one process), a local one of our own."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own_dir()


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="stintline-llm-")


class Scratch:
    """Tables written once and read several times.

    `write` stores a frame as Parquet under the shared folder and reads it back, which cuts the lineage: a lost executor
    costs a re-read, never a recomputation. `drop` removes tables that no later plan reads; what a returned plan still reads
    goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/stintline-{uuid.uuid4().hex}"
        self._made = 0
        self._delete(self.root, at_exit=True)

    def write(self, frame: DataFrame) -> DataFrame:
        self._made += 1
        path = f"{self.root}/{self._made}"
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._delete(frame._scratch_path)

    def _delete(self, path: str, at_exit: bool = False) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if at_exit:
            files.mkdirs(where)
            files.deleteOnExit(where)
        else:
            files.delete(where, True)
