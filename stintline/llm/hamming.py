"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of a rotated, centred vector; the rotation is learned on a bounded sample by alternating between the signs
and the nearest rotation (iterative quantisation). A code is cut into substrings, each with a table from substring value to
vectors. Two codes within Hamming distance r agree in some substring up to floor(r / tables) bits (pigeonhole), so probing
every table within that radius finds all codes within r. What is within r is ranked by the inner product of the floats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # vectors the rotation and the radius are learned on, at most
TABLES = 4
BLOCK = 1 << 16  # vectors of one index block, about
QUERIES = 1 << 12  # queries that meet a block at once, about
RECALL = 0.97  # of the sample's own neighbours within the radius


@dataclass
class Codes:
    """Centre, rotation and radius; bits is the number of columns of the rotation."""

    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """A row of 16-bit substrings for each vector."""
        bits = (vectors - self.centre) @ self.rotation > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint16)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and finite components, none null, not all zero."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)))


def learn(vectors: DataFrame, k: int, sample: int = SAMPLE, tables: int = TABLES, steps: int = 40) -> Codes | None:
    """Codes of 16 * tables bits from a bounded sample, the first by a hash of the id; none from no vectors.

    The radius holds RECALL of the k nearest neighbours of up to 400 sampled queries within the sample. In the whole table
    neighbours are nearer than in a sample, so the radius errs on the large side there.
    """
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if rows.empty:
        return None
    width = rows.vector.str.len().mode()[0]
    x = np.stack([v for v in rows.vector if len(v) == width])
    bits = 16 * tables
    centre = x.mean(0)
    z = x - centre
    random = np.random.Generator(np.random.PCG64(3))
    basis = np.linalg.svd(z, full_matrices=False)[2] if len(z) else np.eye(width)
    extra = random.normal(size=(width, max(0, bits - len(basis))))
    basis = np.concatenate([basis[:bits], extra.T / np.sqrt(width)]).T[:, :bits]
    turn = np.linalg.qr(random.normal(size=(bits, bits)))[0]
    y = z @ basis
    for _ in range(steps):
        left, _, right = np.linalg.svd(np.sign(y @ turn).T @ y)
        turn = (left @ right).T
    codes = Codes(centre, basis @ turn, bits)
    query = np.arange(0, len(x), max(1, len(x) // 400))
    near = x[query] @ x.T
    near[np.arange(len(query)), query] = -np.inf
    best = np.argpartition(-near, min(k, len(x) - 1), 1)[:, :k]
    packed = codes.encode(x)
    apart = np.bitwise_count(packed[query][:, None, :] ^ packed[best]).sum(2)
    codes.radius = int(np.quantile(apart, RECALL)) if len(x) > 1 else bits
    return codes


class MultiIndex:
    """The tables of one block: for every substring value the codes that have it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for t in range(codes.shape[1]):
            order = np.argsort(codes[:, t], kind="stable")
            values, begins = np.unique(codes[order, t], return_index=True)
            self.tables.append((values, np.append(begins, len(order)), order))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs from the query's in at most radius bits.

        A table's keys within the probing radius are found by comparing the query's substring with the keys that exist, which
        are at most 65,536 and never more than the block's codes.
        """
        near = radius // len(self.tables)
        hit = np.zeros(len(self.codes), bool)
        for t, (values, begins, order) in enumerate(self.tables):
            keys = np.flatnonzero(np.bitwise_count(values ^ query[t]) <= near)
            size = begins[keys + 1] - begins[keys]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            hit[order[np.repeat(begins[keys], size) + within]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ query).sum(1) <= radius]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            codes: Codes | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k vectors of largest inner product found for each query, itself left out.

    Ties go to the smaller id; a query with fewer than k neighbours within the radius is completed from all vectors of its
    length, so it has k rows wherever there are as many candidates. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do vectors of another length than the query. Rows that repeat an id and vector count once. An empty table gives none.
    """
    base = usable(vectors, id_col, vec_col).distinct()
    asked = usable(queries, id_col, vec_col).distinct()
    codes = codes or learn(base, k)
    out = "query_id long, vec_id long, score double"
    spark = vectors.sparkSession
    if codes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, q = base.count(), asked.count()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-q // QUERIES))
    # Blocks of all rows by blocks of the stated queries.
    left = base.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    right = asked.withColumns({"part": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int"), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    held = spark.sparkContext.broadcast(codes)

    def search(rows: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        found = [x for size in sorted({len(v) for v in ask.vector}) for x in _search(rows[rows.vector.str.len() == size], ask[ask.vector.str.len() == size], held.value, k)]
        return pd.DataFrame({c: np.concatenate([x[i] for x in found]) if found else [] for i, c in enumerate(("query_id", "vec_id", "score"))}).astype({"query_id": "int64", "vec_id": "int64", "score": float})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(search, out)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: at most k rows a block, sorted as bounded arrays and put together."""
    best = found.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("a"))
    rows = best.select("query_id", F.posexplode(F.slice("a", 1, k)).alias("rank", "r"))
    return rows.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), (-F.col("r.s")).alias("score"))


def _search(rows: pd.DataFrame, ask: pd.DataFrame, codes: Codes, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if rows.empty or ask.empty:
        return
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.vector)
    index = MultiIndex(codes.encode(x)) if x.shape[1] == len(codes.centre) else None
    y = np.stack(ask.vector)
    coded = codes.encode(y) if index else None
    for a, query in enumerate(ask.vec_id.to_numpy()):
        got = index.within(coded[a], codes.radius) if index else np.arange(len(ids))
        got = got[ids[got] != query]
        if len(got) < k:  # too few within the radius: all of the block, exactly
            got = np.flatnonzero(ids != query)
        score = np.einsum("ij,j->i", x[got], y[a])
        if len(got) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            got, score = got[score >= edge], score[score >= edge]
        order = np.lexsort((ids[got], -score))[:k]
        yield np.full(len(order), query), ids[got][order], score[order]
