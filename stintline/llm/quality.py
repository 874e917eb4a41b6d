"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters, of digits or of other marks. Features are hashed into 2 ** bits slots: the token, the pair with
its predecessor, and the shapes of both (kind, case, length, whether a token repeats one of the two before it). A document is
the sparse vector of its slots' counts divided by its number of tokens; its score is the sparse dot product with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm.memory import give_back
from stintline.llm.wordhash import LOWER, hash_spans, mix, runs

BITS = 18
SAMPLE = 12_000  # labelled documents the classifier is fitted on, at most
SHARD = 4_000  # documents that one fitting task gets, about
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.05
SCALE = 8.0  # of a slot's share of the tokens

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 mark
_KIND[[32, *range(9, 14)]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_PIECE = 1 << 20


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, token hashes, shapes) of one buffer that ends with a space."""
    starts, hashes, shapes, at = [], [], [], 0
    while at < len(data):
        stop = len(data)
        if stop - at > 2 * _PIECE:  # a very long text goes in pieces, cut where the kind changes
            stop = at + _PIECE
            while stop < len(data) and _KIND[data[stop]] == _KIND[data[stop - 1]]:
                stop += 1
        piece = data[at:stop]
        kind = _KIND[piece]
        edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
        ends = np.append(edge[1:], len(piece))
        word = kind[edge] > 0
        s, e = edge[word], ends[word]
        of = kind[s].astype(np.uint64)
        size = np.minimum(e - s, 24).astype(np.uint64)
        h = hash_spans(LOWER[piece], s, e)
        h = np.where(of == 2, size, h)  # a number is its length
        upper = ((piece[s] >= 65) & (piece[s] <= 90)).astype(np.uint64) + ((piece[e - 1] >= 65) & (piece[e - 1] <= 90)).astype(np.uint64)
        glued = np.append(s[1:], -1) == e  # the next token follows without a space
        starts.append(s + at)
        hashes.append(h)
        shapes.append(of + (upper << np.uint64(2)) + ((np.minimum(size, 5)) << np.uint64(4)) + (glued.astype(np.uint64) << np.uint64(8)))
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes), np.concatenate(shapes)


def features(column: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, token bounds of each document, slots: a row of four for every token) of runs of documents."""
    for first, _, data, offsets in runs(column):
        starts, h, shape = _tokens(data)
        bounds = np.searchsorted(starts, offsets)
        slots = np.empty((len(h), 4), np.int32)
        opens = np.zeros(len(h), bool)
        opens[bounds[:-1][bounds[:-1] < len(h)]] = True
        back = np.where(opens, np.uint64(0), np.roll(h, 1)) if len(h) else h
        back2 = np.where(opens | np.roll(opens, 1), np.uint64(0), np.roll(h, 2)) if len(h) else h
        before = np.where(opens, np.uint64(0), np.roll(shape, 1)) if len(h) else shape
        again = ((h == back) | (h == back2)).astype(np.uint64)
        for k, x in enumerate((mix(h), mix(h + back * np.uint64(3)), mix(shape * np.uint64(5) + again), mix((shape << np.uint64(20)) + (before << np.uint64(2)) + again + np.uint64(1 << 60)))):
            slots[:, k] = (x >> np.uint64(64 - bits)).astype(np.int32)
        yield first, bounds, slots


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def follow_the_leader(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (slot 2 ** bits is the bias) after FTRL-proximal passes over (slots, values) documents."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.Generator(np.random.PCG64(11))
    for _ in range(epochs):
        for k in order.permutation(len(docs)):
            i, x = docs[k]
            w = weights(i)
            g = (_sigmoid(w @ x) - labels[k]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled documents, first by a hash of the id.

    Repeated ids and labels other than 0 and 1 are left out of labels; the ids, of bounded number, are sent to the documents.
    """
    known = (labels.where(f"{id_col} is not null and {label} in (0, 1)").groupBy(id_col).agg(F.min(label).alias("label"), F.max(label).alias("other"))
             .where("label = other").select(F.col(id_col).alias("doc_id"), "label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id")


def fit(labelled: DataFrame, bits: int = BITS) -> np.ndarray:
    """Weights from (text, label) rows, a bounded sample: each shard of it learns alone, and the weights are averaged."""
    def shard(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["doc_id", "text"], ignore_index=True)
        docs = []
        for _, bounds, slots in features(pa.array(groups.text, pa.string()), bits):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                i, c = np.unique(slots[a:b], return_counts=True)
                docs.append((np.append(i, 1 << bits), np.append(c * (SCALE / max(1, b - a)), 1.0)))
        w = follow_the_leader(docs, groups.label.to_numpy(float), bits)
        kept = np.flatnonzero(w)
        del docs
        give_back()
        return pd.DataFrame({"slot": kept, "weight": w[kept]})

    n = labelled.count()
    shards = max(1, -(-n // SHARD))
    dealt = labelled.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)))
    got = dealt.groupBy("shard").applyInPandas(shard, "slot int, weight double").groupBy("slot").agg((F.sum("weight") / shards).alias("w")).toArrow()
    weights = np.zeros((1 << bits) + 1)
    weights[got.column("slot").to_numpy()] = got.column("w").to_numpy()
    return weights


def _chances(column: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(column))
    for first, bounds, slots in features(column, bits):
        sums = np.concatenate([[0.0], np.cumsum(weights[slots].sum(1))])
        out[first : first + len(bounds) - 1] = (sums[bounds[1:]] - sums[bounds[:-1]]) * SCALE / np.maximum(1, np.diff(bounds))
    return _sigmoid(out + weights[-1])


def chance(text_col: str, weights: np.ndarray, spark: SparkSession, bits: int = BITS) -> Column:
    """The chance of label 1 as a column. Null, empty and blank texts have no tokens and score by the bias."""
    held = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        out = pa.array(_chances(texts, held.value, bits))
        give_back()
        return out

    return of(F.col(text_col).cast("string"))


def scored(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), chance(text_col, weights, docs.sparkSession, bits).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", **names) -> DataFrame:
    """Fit on the labelled rows given and score all documents. Without labels every score is 0.5."""
    return scored(docs, fit(sample_labelled(docs, labels, label, **names)), **names)
