"""Cut a long lineage with a table written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="stintline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset, as in tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own_folder()


def materialised(df: DataFrame) -> DataFrame:
    """Write once, read back as Parquet: prunable, and safe when executors are lost.

    Used where several branches would otherwise recompute the same wide plan. The file goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stintline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
