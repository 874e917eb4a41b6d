"""Ordered scans that split one key over many tasks.

A plain ``partitionBy(key).orderBy(...)`` window puts a whole key in one task,
which fails when one key holds a third of the data. Both kernels below cut the
order column into fixed blocks, scan inside ``(key, block)``, reduce each block
to one row, scan those, and join the carry back. The join runs on the
partitioning the inner window already needs, so the price of being safe is one
small shuffle of block rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

BLOCK = 4096


def int_block(order: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(order) / size)


def time_block(ts: str, seconds: int = 3600) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value, out: str, block: Column
) -> DataFrame:
    """Inclusive running sum of ``value`` (nulls count as nothing)."""
    value = F.col(value) if isinstance(value, str) else value
    cut = df.withColumn("_block", block).withColumn("_v", value)
    per_block = cut.groupBy(*keys, "_block").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(
        *keys, "_block", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry")
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.col("_carry") + F.coalesce(F.sum("_v").over(inside), F.lit(0))
    return cut.join(carry, [*keys, "_block"]).withColumn(out, total).drop("_block", "_v", "_carry")


def stepped_total(
    df: DataFrame, keys: list[str], order: str, value: str, step: Callable[[Column, Column], Column], out: str, block: Column,
) -> DataFrame:
    """Running sum of ``step(value before, value here)``; a key's first row adds nothing.

    The carry of a block holds its last value as well as its sum, so the step over
    a block's edge is taken between block rows and the rows are laid out once.
    """
    cut = df.withColumn("_block", block)
    rows = Window.partitionBy(*keys, "_block").orderBy(order)
    here = cut.withColumn("_p", F.lag(value).over(rows)).withColumn("_s", F.coalesce(step(F.col("_p"), F.col(value)), F.lit(0.0)))
    inside = here.withColumn("_in", F.sum("_s").over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per_block = here.groupBy(*keys, "_block").agg(F.sum("_s").alias("_t"), F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    blocks = Window.partitionBy(*keys).orderBy("_block")
    edge = F.coalesce(step(F.lag("_last").over(blocks), F.col("_first")), F.lit(0.0))
    linked = per_block.withColumn("_edge", edge).select(*keys, "_block", (F.sum(F.col("_edge") + F.col("_t")).over(
        blocks.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_t")).alias("_carry"))
    return inside.join(linked, [*keys, "_block"]).withColumn(out, F.col("_in") + F.col("_carry")).drop("_block", "_p", "_s", "_in", "_carry")


def known_around(
    df: DataFrame, keys: list[str], order: list[str], block: Column,
    back: dict[str, Column] | None = None, ahead: dict[str, Column] | None = None, inclusive: bool = True,
    before: dict[str, Column] | None = None, whole: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None, place: str | None = None,
) -> DataFrame:
    """Nearest non-null values before and after each row.

    ``back`` names the latest non-null expression at or before the row, ``ahead``
    the first one at or after it. ``inclusive=False`` leaves the row itself out,
    as ``before`` does for the latest ones it names. ``whole`` names facts of a
    key: the aggregate of a block, and how those of its blocks are put together.
    ``place`` is a number that by itself orders the rows on which any one
    expression is known; with it the edges of blocks are aggregated by hash.
    """
    back, ahead, before, whole = back or {}, ahead or {}, before or {}, whole or {}
    behind = {**back, **before}
    cut = df.withColumn("_block", block)
    marks = {f"_m_{name}": e for name, e in {**behind, **ahead}.items()}
    position = F.struct(*order)

    marked = cut.withColumns(marks)

    def edge(name: str) -> Column:
        mark = F.col(f"_m_{name}")
        if place:
            nearest, at, kind = F.max_by if name in behind else F.min_by, F.when(mark.isNotNull(), F.col(place)), marked.schema[f"_m_{name}"].dataType
            value = F.struct(*[nearest(mark[f], at).alias(f) for f in kind.names]) if isinstance(kind, StructType) else nearest(mark, at)
            return F.when(F.count(mark) > 0, F.struct(value.alias("v"))).alias(f"_b_{name}")
        present = F.when(mark.isNotNull(), F.struct(position.alias("p"), mark.alias("v")))
        return (F.max if name in behind else F.min)(present).alias(f"_b_{name}")

    facts = [e.alias(f"_w_{n}") for n, (e, _) in whole.items()]
    per_block = marked.groupBy(*keys, "_block").agg(*[edge(n) for n in (*behind, *ahead)], *facts)
    # What lies ahead is what came before in the reverse order: a frame that grows row by row, where one that shrinks is read anew for each row.
    blocks, turned = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys).orderBy(F.desc("_block"))
    rows = Window.partitionBy(*keys, "_block").orderBy(*order)
    reverse = Window.partitionBy(*keys, "_block").orderBy(F.desc("_row_no"))
    upto = rows.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = rows.rowsBetween(Window.unboundedPreceding, -1)
    onward = reverse.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    def carried(name: str) -> Column:
        found = F.last(f"_b_{name}", True).over((blocks if name in behind else turned).rowsBetween(Window.unboundedPreceding, -1))
        return found["v"].alias(f"_c_{name}")

    told = [together(F.col(f"_w_{n}")).over(Window.partitionBy(*keys)).alias(n) for n, (_, together) in whole.items()]
    carry = per_block.select(*keys, "_block", *[carried(n) for n in (*behind, *ahead)], *told)
    # What is looked for is made again once the rows are laid out, so that it is not shuffled beside the columns it comes from;
    # the carry meets rows that are in order already, so that they are not sorted for it, nor with it.
    out = cut.repartition(*keys, "_block").withColumns(marks)

    def near(names: dict[str, Column], frame) -> dict[str, Column]:
        return {n: F.last(f"_m_{n}", True).over(frame) for n in names}

    if ahead:
        out = out.withColumn("_row_no", F.row_number().over(rows))
    out = out.withColumns({**near(back, upto), **near(before, earlier)}) if behind else out
    out = out.withColumns(near(ahead, onward)) if ahead else out
    out = out.join(carry, [*keys, "_block"]).withColumns({n: F.coalesce(F.col(n), F.col(f"_c_{n}")) for n in (*behind, *ahead)})
    return out.drop("_block", "_row_no", *[f"_{p}_{n}" for n in (*behind, *ahead) for p in "mc"])


def last_known(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], block: Column,
               inclusive: bool = True, place: str | None = None) -> DataFrame:
    return known_around(df, keys, order, block, back=values, inclusive=inclusive, place=place)


def closed_ring(df: DataFrame, key: str, halo: int | Column, block: int = BLOCK) -> tuple[DataFrame, object]:
    """Lay a closed lap out so that frames of up to ``halo`` rows wrap and split; it may be a column, one value a lap.

    ``df`` has a dense ``idx`` from 0 and its length ``n``. Samples near the line
    are repeated on the other side of it, and samples near a block edge in the
    next block. Returns the rows with ``pos``, ``core`` (false for the copies)
    and the window to use; keep only ``core`` rows afterwards.
    """
    pos = F.explode(F.array_compact(F.array(
        F.col("idx"), F.when(F.col("idx") < halo, F.col("idx") + F.col("n")),
        F.when(F.col("idx") >= F.col("n") - halo, F.col("idx") - F.col("n")))))
    laid = df.withColumn("pos", pos).withColumn("_block", F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor((F.col("pos") - halo) / block)).cast("int"),
        F.greatest(F.lit(0), F.least(F.floor((F.col("n") - 1) / block), F.floor((F.col("pos") + halo) / block))).cast("int"))))
    core = (F.col("pos") == F.col("idx")) & (F.col("_block") == F.floor(F.col("idx") / block))
    return laid.withColumn("core", core), Window.partitionBy(key, "_block").orderBy("pos")
