"""Exact ranks of large groups without gathering a group in one task.

Equal values are counted first. A group's range is cut into blocks; one row per block tells which block holds a wanted rank,
and only that block is put in order. Ranks are whole numbers, so they do not depend on the size of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCKS = 1024

#: out column -> (value column, "median" or (numerator, denominator) of a nearest rank floor(p * n))
Wanted = dict[str, tuple[str, str | tuple[int, int]]]


def _indexes(kind: str | tuple[int, int]) -> Column:
    if kind == "median":
        return F.expr("array_distinct(array((_n - 1) div 2, _n div 2))")
    return F.expr(f"array(least(_n - 1, (_n * {kind[0]}) div {kind[1]}))")


def ranked(df: DataFrame, keys: list[str], wanted: Wanted) -> DataFrame:
    """One row per group with the asked medians and nearest ranks; nulls are left out, a group of nulls gives no row."""
    cells = F.explode(F.array(*[F.struct(F.lit(out).alias("_out"), F.col(value).cast("double").alias("_v")) for out, (value, _) in wanted.items()]))
    group = [*keys, "_out"]
    counts = (df.select(*keys, cells.alias("_cell")).select(*keys, "_cell.*").where("_v IS NOT NULL")
              .groupBy(*group, "_v").agg(F.count("*").alias("_c")))
    extent = counts.groupBy(*group).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BLOCKS)
    cut = counts.join(extent, group).withColumn("_block", F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(F.lit(BLOCKS - 1), place)))
    order = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index = F.lit(None)
    for out, (_, kind) in wanted.items():
        index = F.when(F.col("_out") == out, _indexes(kind)).otherwise(index)
    blocks = cut.groupBy(*group, "_block").agg(F.sum("_c").alias("_bc"), F.first("_n").alias("_n"))
    held = (blocks.withColumn("_before", F.sum("_bc").over(order) - F.col("_bc")).withColumn("_i", F.explode(index))
            .where("_before <= _i AND _i < _before + _bc").select(*group, "_block", "_i", "_before"))
    within = Window.partitionBy(*group, "_block", "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (cut.select(*group, "_block", "_v", "_c").join(held, [*group, "_block"])
             .withColumn("_at", F.col("_before") + F.sum("_c").over(within)).where("_at - _c <= _i AND _i < _at"))
    return found.groupBy(*keys).agg(*[F.avg(F.when(F.col("_out") == out, F.col("_v"))).alias(out) for out in wanted])
