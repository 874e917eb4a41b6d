"""Derived tables out: partitioned, stamped, and safe to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTITIONS = ["season", "session_id"]


def write_table(df: DataFrame, folder: str, name: str, schema_version: int, source: str, partitions: list[str] | None = None,
                order: list[str] | None = None) -> str:
    """Replace the partitions present in ``df`` and leave every other one alone.

    Rows are laid out by partition first, so a partition is written by few tasks
    and a large one may still be split by the adaptive plan. Inside a file rows lie
    by partition and then by ``order``, so that readers can skip row groups by it.
    """
    partitions = [c for c in (PARTITIONS if partitions is None else partitions) if c in df.columns]
    stamped = df.withColumns({"schema_version": F.lit(schema_version), "source": F.lit(source), "generated_at": F.current_timestamp()})
    path = f"{folder}/{name}"
    laid = stamped.hint("rebalance", *partitions) if partitions else stamped
    by = [*partitions, *(order or [])]
    writer = (laid.sortWithinPartitions(*by) if by else laid).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return path
