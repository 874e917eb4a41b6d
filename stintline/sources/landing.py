"""Landed JSON files as text: whole documents, or the records of large arrays cut in parallel.

A feed that answers with one long array must not be one task. ``records`` reads a file by byte ranges, as pieces that end with a
closing brace, and finds out which of these braces close a record:

* a brace counts only outside of strings, so the number of quotes before a piece is needed: quotes are summed by byte range, the
  ranges of a file are added up (one row a range), and inside a range a running sum goes on from there;
* braces are then summed in the same way, and a record is what lies between two places of depth nought.

Nearly every piece of a flat record is a record already and goes straight through. Only records cut by a brace in a string or by
a nested object are put together again, by their first byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stintline.functions.scans import last_known

_RANGE = ["file", "block"]
_PACKED = r"(?i)\.(gz|bz2|zst|deflate|lz4|snappy|xz)$"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole files: for feeds that answer in pages of bounded size. Small files share tasks."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _carried(rows: DataFrame, **values) -> DataFrame:
    """Sums of the values over all earlier rows of the file, inside a range by a window, before it by one row a range."""
    named = rows.withColumns({f"_{name}": value for name, value in values.items()})
    totals = named.groupBy(*_RANGE).agg(*[F.sum(f"_{name}").alias(f"_t_{name}") for name in values])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*_RANGE, *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_c_{name}") for name in values])
    inside = Window.partitionBy(*_RANGE).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    local = named.withColumns({f"_l_{name}": F.coalesce(F.sum(f"_{name}").over(inside), F.lit(0)) for name in values})
    return local.join(carry, _RANGE).withColumns({name: F.col(f"_l_{name}") + F.col(f"_c_{name}") for name in values}).drop(
        *[f"{kind}{name}" for name in values for kind in ("_l_", "_c_")])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, text) of every JSON object that lies at depth nought of a file or in its outermost array.

    ``offset`` counts the bytes before the piece the record starts in, so it orders the records of a file, whatever the ranges.
    An object that the end of the file cuts off is left out; an empty file or array has none.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("row"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    known = _carried(pieces, quotes=quotes, offset=F.octet_length("value") + 1)

    starts_inside = F.col("quotes") % 2 == 1
    outside = F.regexp_replace(F.when(starts_inside, F.concat(F.lit('"'), plain)).otherwise(plain), r'"[^"]*("|$)', "")
    opened = F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))
    closed = ((F.col("quotes") + F.col("_quotes")) % 2 == 0) & (F.col("file").rlike(_PACKED) | (F.col("offset") + F.col("_offset") <= F.col("file_size")))
    known = known.withColumns({"opened": opened, "closed": closed.cast("int")}).drop("_quotes", "_offset", "quotes", "file_size")
    placed = _carried(known, depth=F.col("opened") - F.col("closed"))

    after = F.col("depth") + F.col("_depth")
    whole = (F.col("depth") == 0) & (after == 0) & (F.col("opened") == 1) & (F.col("closed") == 1)
    alone = placed.where(whole).select("file", "offset", F.concat(F.expr("substr(value, instr(value, '{'))"), F.lit("}")).alias("text"))
    parts = placed.where(~whole).withColumn("end", after)
    parts = last_known(parts, ["file"], ["offset"], {"start": F.when((F.col("depth") == 0) & (F.col("opened") > 0), F.col("offset"))}, F.col("block"))
    glued = parts.where("start is not null").where((F.col("depth") > 0) | (F.col("opened") > 0)).groupBy("file", "start").agg(
        F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("p"), F.max_by("end", "offset").alias("end"), F.max_by("closed", "offset").alias("closed"))
    joined = F.concat(F.array_join(F.col("p.value"), "}"), F.lit("}"))
    glued = glued.where("end = 0 and closed = 1").select("file", F.col("start").alias("offset"), joined.alias("text"))
    return alone.unionByName(glued.withColumn("text", F.expr("substr(text, instr(text, '{'))")))
