"""Members of groups compared block by block inside tasks, without a row for a pair.

A group of up to `whole` members is one run of rows (leaf, 0, 0); a larger one is dealt into blocks by hash, and every two blocks
that have something to compare are a run (leaf, i, j). What leaves a task is a spanning forest at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.memory import give_back, lean

BLOCK_GRAMS = 1 << 21  # n-grams of a block whose full sets are compared


def dealt_blocks(placed: DataFrame, whole: int, block: int, *carried: str, weight: str | None = None, diagonal: bool = False) -> DataFrame:
    """Rows dealt to (leaf, i, j): i = j = 0 in a leaf of up to `whole` members, else the pairs of blocks that have something to compare.

    A leaf's blocks are dealt by hash. Where rows have a class, those of its largest class are dealt apart and never meet each
    other; all others meet. Without a class, or with `diagonal`, a block meets only itself.
    """
    apart = "class" in placed.columns and not diagonal
    size = [F.count("*").alias("c"), *([F.sum(weight).alias("w")] if weight else [F.lit(0).alias("w")])]
    if apart:
        by_class = placed.groupBy("leaf", "class").agg(*size)
        sizes = by_class.groupBy("leaf").agg(F.max(F.struct("c", "class")).alias("l"), F.sum("c").alias("c"), F.sum("w").alias("w"))
        sizes = sizes.select("leaf", "c", "w", F.col("l.class").alias("main"), F.col("l.c").alias("in_main"))
    else:
        sizes = placed.groupBy("leaf").agg(*size).withColumn("in_main", F.lit(0))
    many = F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("w") / BLOCK_GRAMS))
    sizes = sizes.withColumn("all", F.when((F.col("c") <= whole) & (F.col("w") <= BLOCK_GRAMS), F.lit(0)).otherwise(many)).withColumn(
        "rest", F.ceil(F.col("all") * (F.col("c") - F.col("in_main")) / F.col("c"))).drop("c", "w")
    dealt = placed.drop("c").join(sizes, "leaf")
    other = F.expr("rest + pmod(xxhash64(node), greatest(all - rest, 1))")
    own = F.expr("pmod(xxhash64(node), greatest(rest, 1))")
    at = F.when(F.col("all") == 0, F.lit(0)).otherwise(F.when(F.expr("class = main"), other).otherwise(own) if apart else own).cast("long")
    met = F.expr("if(all = 0, array(0L), if(at < rest, sequence(0L, greatest(all, rest + 1) - 1), sequence(0L, rest - 1)))" if apart else
                 "if(all = 0, array(0L), array(at))")
    dealt = dealt.withColumn("at", at).withColumn("met", F.explode(met))
    return dealt.select("leaf", F.least("at", "met").alias("i"), F.greatest("at", "met").alias("j"), "at", "node", "n", *carried)


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of rows with equal (leaf, i, j), which may go on over several batches."""
    carry: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        marks = np.stack([table.column(c).to_numpy() for c in ("leaf", "i", "j")], 1)
        bounds = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), table.num_rows]
        for start, end in zip(bounds, bounds[1:], strict=False):
            if carry and (start or carry[0].slice(0, 1).select(["leaf", "i", "j"]).to_pylist() != table.slice(0, 1).select(["leaf", "i", "j"]).to_pylist()):
                yield pa.concat_tables(carry)
                carry = []
            carry.append(table.slice(start, end - start))
    if carry:
        yield pa.concat_tables(carry)


def whole_runs(rest: list[pa.RecordBatch], end: bool) -> list[pa.Table]:
    """The runs that the batches hold in full, taken off them: all but the last one, and at the end that one too."""
    runs = list(block_runs(iter(rest)))
    rest.clear()
    if runs and not end:
        rest.extend(runs.pop().to_batches())
    return runs


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the edges, taken in order, tie together what no earlier one did."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = np.zeros(len(u), bool)
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            up[a] = b
            out[k] = True
    return out


def pair_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64())], ["u", "v"])


def overlap_matrix(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all left sets with all right sets, by products of incidence blocks of 4,096 n-grams."""
    flat = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(common):
        return out
    cells = []
    for sets, all_of in zip((left, right), flat, strict=True):
        column = np.minimum(np.searchsorted(common, all_of), len(common) - 1)
        hit = common[column] == all_of
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit]
        column = column[hit]
        order = np.argsort(column, kind="stable")
        cells.append((row[order], column[order]))
    for start in range(0, len(common), 4096):
        blocks = []
        for (row, column), sets in zip(cells, (left, right), strict=True):
            a, b = np.searchsorted(column, [start, start + 4096])
            held = np.zeros((len(sets), min(4096, len(common) - start)), np.float32)
            held[row[a:b], column[a:b] - start] = 1
            blocks.append(held)
        out += (blocks[0] @ blocks[1].T).astype(np.int64)
    return out


def links_between(active: DataFrame, percent: int, leaf: int, block: int, run_of: Callable) -> DataFrame:
    """(u, v) classes that a confirmed link ties together: in each leaf a spanning forest of them, judged on the full sets.

    `active` is (leaf, node, n, sketch, class, grams); `run_of(table, percent)` tells with `likely()` which pairs of a run may link.
    """
    def judge(batches):
        for table in block_runs(batches):
            run = run_of(table, percent)
            a, b, _ = run.likely()
            if not len(a):
                continue
            sets = {k: np.frombuffer(table.column("grams")[int(k)].as_py(), np.uint64) for k in np.unique(np.concatenate([a, b])).tolist()}
            if len(a) <= 4 * (len(run.left) + len(run.right)):
                both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            else:
                left, right = np.unique(a), np.unique(b)
                both = overlap_matrix([sets[k] for k in left.tolist()], [sets[k] for k in right.tolist()])[np.searchsorted(left, a), np.searchsorted(right, b)]
            size = np.zeros(len(run.n), np.int64)
            size[list(sets)] = [len(x) for x in sets.values()]
            linked = np.flatnonzero(100 * both >= percent * (size[a] + size[b] - both))
            u, v = run.of[a[linked]], run.of[b[linked]]
            kept = forest(u, v)
            if kept.any():
                yield pair_batch(u[kept], v[kept])
            del sets
            give_back()

    order = ["leaf", "i", "j"]
    return (dealt_blocks(active, leaf, block, "sketch", "class", "grams", weight="n").repartition(*order).sortWithinPartitions(*order)
            .mapInArrow(lean(judge), "u long, v long").distinct())
