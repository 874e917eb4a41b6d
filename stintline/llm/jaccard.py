"""N-gram Jaccard join: size-aware heavy-light similarity join, exact, returned as connected classes.

A document's set holds its distinct word n-grams; two documents link when 100 * |A n B| >= percent * |A u B|.

* Equal sets are one class member (a hash of the set, combined before the shuffle), so copies are never paired.
* Light (small) sets enumerate all subsets of the sizes that a link can need: two light sets that link need an overlap of
  exactly c = ceil(percent / (100 + percent) * (|A| + |B|)) and so share a c-subset.
* Heavy (large) sets go to inverted lists over their rarest n-grams: sets that link share one within their first
  |A| - ceil(percent * |A| / 100) + 1 in any common order. The order comes from counts over all documents: of the n-grams whose
  hash lies in the lowest SHARE, those of one set only come first, then the n-grams outside that share, then those of several
  sets. What is known to be of one set needs no list, so most documents post nothing. Which are of several is kept in a bitmap
  of fixed size; a collision in it changes the order, never the result.
* The boundary is the largest size at which the subsets still cost less than scanning the lists, by the mean list length
  that was counted. Light sets that can link to a heavy one are in the lists too.
* Within a list, members are compared in the task by an upper bound of their overlap; only a spanning forest of the pairs that it
  leaves possible becomes rows. Every member's likeliest partner is confirmed on the full sets first, and what links is one class.
* Lists that still hold several classes are gone through again. What is possible between different classes ties their members to
  clusters, each member in one; a cluster's full sets are then compared exactly, blocks against blocks, and only a spanning forest of
  the classes that link leaves the task. So the rows of pairs are no more than the members, however large a family of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.blocks import dealt_blocks, forest, links_between, pair_batch, whole_runs
from stintline.llm.components import components
from stintline.llm.memory import give_back, lean
from stintline.llm.scratch import Scratch
from stintline.llm.wordhash import ROWS, grams, mix, word_runs

SHARE = 0.25  # of the n-grams, by hash, are counted for the order
BITMAP_BITS = 26  # the bitmap of n-grams of several sets: 2 ** 26 bits, whatever the corpus
MAX_LIGHT = 26  # beyond this size the subsets never pay
VERIFY_COST = 8.0  # of one compared candidate, in index rows
LEADER_ROUNDS = 1  # in which each member is tested against its likeliest partner in another class
BOUND_CELLS = 256  # of the histogram that bounds an overlap from above
SHORT = 4  # members of a list whose pairs are taken at once with those of other such lists
BLOCK = 512  # members of a list or cluster that one task holds of each of two blocks; one of no more is compared whole


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _overlaps(n: int, percent: int, light: int) -> list[int]:
    """The overlaps that a set of size n needs with some light set."""
    partners = range(_least_overlap(n, percent), min(light, 100 * n // percent) + 1)
    return sorted({-(-percent * (n + b) // (100 + percent)) for b in partners})


def _prefix(n: int, percent: int) -> int:
    return n - _least_overlap(n, percent) + 1


def light_boundary(percent: int, crowding: float, most: int = MAX_LIGHT) -> int:
    """The largest n up to which enumerating subsets costs no more than scanning the inverted lists."""
    light = 0
    for n in range(1, most + 1):
        enumerated = sum(comb(n, c) for c in _overlaps(n, percent, n))
        if enumerated > _prefix(n, percent) * (1 + VERIFY_COST * max(0.0, crowding - 1)) + VERIFY_COST:
            break
        light = n
    return light


def _sets(column: pa.Array, n_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text."""
    for first, bounds, _, _, hashes in word_runs(column):
        for k in range(len(bounds) - 1):
            got = grams(hashes[bounds[k] : bounds[k + 1]], n_words)
            yield first + k, np.unique(got)


def _set_mark(got: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    if not len(got):
        return 0, 0
    return int(np.bitwise_xor.reduce(mix(got ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)), int(got.sum(dtype=np.uint64).view(np.int64))


def _counted(got: np.ndarray) -> np.ndarray:
    """The n-grams whose hash lies in the lowest SHARE: a leading stretch of the sorted hashes."""
    return got[: np.searchsorted(got, np.uint64(int(SHARE * 2**64)))]


def _slots(got: np.ndarray, bits: int) -> np.ndarray:
    return (mix(got) >> np.uint64(64 - bits)).astype(np.int64)


def _keyed(keys: list[np.ndarray], marks: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(marks))], ["key", "mark"])


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit for the slot of every key, 32 to a word: at most 2 ** (bits - 5) words come to the driver, however many keys."""
    def slots(batches):
        for batch in batches:
            at = _slots(batch.column(0).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(1 << (at & 31))], ["word", "bit"])

    words = keys.mapInArrow(lean(slots), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return table


def _marked(got: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    at = _slots(got, bits)
    return (table[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0


def shared_grams(texts: DataFrame, n_words: int, bits: int, scratch: Scratch) -> tuple[np.ndarray, bool, float]:
    """A bitmap of the counted n-grams that several different sets hold; whether it has all of them; the rows of one on average.

    Where they would fill more than an eighth of the bitmap, only those in more rows are marked.
    """
    def count(batches):
        keys, marks, held = [], [], 0
        for batch in batches:
            for _, got in _sets(batch.column(0), n_words):
                part = _counted(got).copy()
                keys.append(part)
                marks.append(np.full(len(part), _set_mark(got)[1]))
                held += len(part)
                if held > 1 << 18:
                    yield _keyed(keys, marks)
                    keys, marks, held = [], [], 0
        if keys:
            yield _keyed(keys, marks)

    counts = texts.mapInArrow(lean(count), "key long, mark long").groupBy("key").agg(F.count("*").alias("c"), F.min("mark").alias("a"), F.max("mark").alias("b"))
    spread = F.struct(F.count("*").alias("keys"), F.sum("c").alias("rows"))
    shared = scratch.write(counts.where("a <> b").select("key", "c"))
    least = 2
    while shared.where(f"c >= {least}").count() > 1 << (bits - 3):
        least *= 2

    table = _bitmap(shared.where(f"c >= {least}").select("key"), bits)
    crowded = shared.agg(spread.alias("s")).first().s
    scratch.drop(shared)
    return table, least == 2, (crowded.rows or 0) / max(1, crowded["keys"])


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80,
                    bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs; component_id is the smallest id reachable by links.

    Words are runs of non-space characters with A-Z lower-cased; a text of fewer than n_words words has its whole sequence
    as one n-gram. Null, empty and blank texts have the empty set and link with nothing. Rows with the same id are one
    document. A null id keeps its row, with a null component, and takes no part. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table, complete, crowding = shared_grams(rows.select("text"), n_words, bitmap_bits, scratch)
    light = light_boundary(percent, crowding)
    order = spark.sparkContext.broadcast(table)

    def posted_grams(got: np.ndarray) -> np.ndarray:
        """What of a set's prefix needs a list: not the n-grams that come first, if they are known to be of this set only."""
        counted = len(_counted(got))
        several = _marked(got[:counted], order.value, bitmap_bits)
        first = got[:counted][~several]
        prefix = np.concatenate([first, got[counted:], got[:counted][several]])[: _prefix(len(got), percent)]
        return prefix[len(first) :] if complete else prefix

    def index(batches):
        for batch in batches:
            ids, sizes, high, low, keys = batch.column(0), [], [], [], []
            for _, got in _sets(batch.column(1), n_words):
                n = len(got)
                sizes.append(n)
                marks = _set_mark(got)
                high.append(marks[0])
                low.append(marks[1])
                parts = []
                if 0 < n <= light:
                    for c in _overlaps(n, percent, light):
                        parts += [mix(np.array([sum(map(int, s)) + (c << 56) & (2**64 - 1) for s in combinations(mix(got + np.uint64(1)), c)], np.uint64))]
                if n > light or 100 * n >= percent * (light + 1):
                    parts.append(posted_grams(got))
                keys.append(np.concatenate(parts).view(np.int64) if parts and n else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "n", "high", "low", "keys"])

    known = scratch.write(rows.mapInArrow(lean(index), "doc_id long, n long, high long, low long, keys array<long>"))
    nodes = (known.where("n > 0 and doc_id is not null").groupBy("high", "low")
             .agg(F.min(F.struct("doc_id", "n", "keys")).alias("r")).select("high", "low", "r.*"))
    nodes = scratch.write(nodes.withColumnRenamed("doc_id", "node"))
    posted = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = scratch.write(posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    lists = scratch.write(posted.join(shared, "key").select("key", "node", "n", "c"))

    # Which documents are in a list is one more bitmap, so the texts are not shuffled; a collision stores a set too many.
    wanted = spark.sparkContext.broadcast(_bitmap(lists.select("node").distinct(), bitmap_bits))
    sets = scratch.write(_stored_sets(rows.where("doc_id is not null"), n_words, wanted, bitmap_bits))

    member = known.join(nodes.select("high", "low", "node"), ["high", "low"], "left")
    member = scratch.write(member.select("doc_id", F.col("n").alias("n_shingles"),
                                         F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("doc_id")).alias("node")))
    # A document whose rows hold different texts ties their classes together.
    edges = scratch.write(member.where("doc_id is not null and doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).join(
        member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select(F.col("doc_id").alias("u")),
        "u", "left_semi"))
    scratch.drop(known, shared)

    lists = scratch.write(lists.join(sets.select("node", "cells").distinct(), "node").select(
        F.col("key").alias("leaf"), "node", "n", "c", F.col("cells").alias("sketch")))
    classes = components(edges, scratch)
    for _ in range(LEADER_ROUNDS):
        pairs = scratch.write(_likeliest(_mixed(lists, classes), percent))
        few = scratch.write(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        found = scratch.write(_verified(pairs, sets.select("node", "grams").join(few, "node", "left_semi"), percent))
        scratch.drop(pairs, few)
        edges = edges.unionByName(found)
        classes = components(edges, scratch)

    possible = scratch.write(_possible(_mixed(lists, classes), percent))
    scratch.drop(nodes, lists)
    if not possible.isEmpty():
        clusters = scratch.write(components(possible, scratch).withColumnRenamed("component", "leaf"))
        placed = clusters.join(classes, "node", "left").select("leaf", "node", F.coalesce("component", "node").alias("class"))
        placed = placed.join(sets.select("node", F.col("size").alias("n"), "grams", F.col("cells").alias("sketch")).distinct(), "node")
        between = scratch.write(links_between(placed, percent, BLOCK, BLOCK, _ListRun))
        scratch.drop(clusters)
        classes = _contracted(classes, between, scratch)
    return member.join(classes, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))


def _mixed(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of the lists that hold several classes, each with its class."""
    placed = lists.join(classes, "node", "left").select("leaf", "node", "n", "c", "sketch", F.coalesce("component", "node").alias("class"))
    mixed = placed.groupBy("leaf").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("leaf")
    return placed.join(mixed, "leaf")


def _contracted(classes: DataFrame, between: DataFrame, scratch: Scratch) -> DataFrame:
    """The classes after the links (u, v) between classes; only these links are gone through."""
    top = components(between, scratch).toDF("component", "top")
    alone = between.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes, "node", "left_anti").select("node", F.col("node").alias("component"))
    return classes.unionByName(alone).join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


class _ListRun:
    """The members of one (leaf, i, j), and which of its pairs an upper bound of the overlap leaves possible."""

    def __init__(self, run: pa.Table, percent: int):
        self.run, self.percent = run, percent
        self.node, self.n, at, self.of = (run.column(c).to_numpy() for c in ("node", "n", "at", "class"))
        self.cells = np.frombuffer(b"".join(run.column("sketch").to_pylist()), np.uint8).reshape(-1, BOUND_CELLS)
        i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
        self.left, self.right, self.same = np.flatnonzero(at == i), np.flatnonzero(at == j), i == j

    def likely(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, share of the bound in both sizes) of the pairs of rows, a stretch of the left side at a time."""
        percent, parts = self.percent, []
        right = self.right
        for start in range(0, len(self.left), 128):
            part = self.left[start : start + 128]
            n, m = self.n[part, None], self.n[None, right]
            fit = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (self.of[part, None] != self.of[None, right])
            if self.same:
                fit &= self.node[part, None] < self.node[None, right]
            a, b = np.nonzero(fit)
            if not len(a):
                continue
            if 8 * len(a) > fit.size > 4096:
                most, full = (x[a, b] for x in _cells_in_common(self.cells[part], self.cells[right]))
            else:
                x, y = self.cells[part[a]], self.cells[right[b]]
                most, full = np.minimum(x, y).sum(1, dtype=np.int64), ((x == 255) & (y == 255)).any(1)
            both = self.n[part[a]] + self.n[right[b]]
            keep = full | ((100 + percent) * most >= percent * both)
            parts.append((part[a[keep]], right[b[keep]], most[keep] / both[keep]))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _short_runs(batch: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]:
    """(u, v, share) of the possible pairs of all runs of up to SHORT rows inside the batch at once, and the rows of all others.

    The first and the last run may go on in other batches and count as others.
    """
    none = np.zeros(0, np.int64)
    if batch.num_rows < 3:
        return none, none, np.zeros(0), batch
    marks = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("leaf", "i", "j")], 1)
    starts = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1])
    sizes = np.diff(np.append(starts, len(marks)))
    short = (sizes <= SHORT) & (starts > 0) & (starts + sizes < len(marks)) & (marks[starts, 1] == marks[starts, 2])
    left = batch.filter(pa.array(~np.repeat(short, sizes)))
    node, n, of = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("node", "n", "class"))
    cells = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sketch")).to_pylist()), np.uint8).reshape(-1, BOUND_CELLS)
    parts = []
    for size in range(2, SHORT + 1):
        at, (i, j) = starts[short & (sizes == size)], np.triu_indices(size, 1)
        a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        fit = (of[a] != of[b]) & (node[a] != node[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[fit], b[fit]
        for k in range(0, len(a), 4096):
            x, y = cells[a[k : k + 4096]], cells[b[k : k + 4096]]
            most, full = np.minimum(x, y).sum(1, dtype=np.int64), ((x == 255) & (y == 255)).any(1)
            both = n[a[k : k + 4096]] + n[b[k : k + 4096]]
            keep = full | ((100 + percent) * most >= percent * both)
            parts.append((node[a[k : k + 4096][keep]], node[b[k : k + 4096][keep]], most[keep] / both[keep]))
    if not parts:
        return none, none, np.zeros(0), left
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), left


def _likeliest(placed: DataFrame, percent: int) -> DataFrame:
    """(u, v): each member with its likeliest partner of another class, in its lists or, in long ones, in its block of them."""
    def best(batches):
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            u, v, share, left = _short_runs(batch, percent)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(share)], ["u", "v", "share"])
            rest.append(left)
            yield from long_ones(rest, False)
        yield from long_ones(rest, True)

    def long_ones(rest: list[pa.RecordBatch], end: bool):
        for table in whole_runs(rest, end):
            run = _ListRun(table, percent)
            a, b, share = run.likely()
            order = np.argsort(-share, kind="stable")
            a, b, share = a[order], b[order], share[order]
            kept = forest(run.node[a], run.node[b])
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(run.node[a[kept]]), pa.array(run.node[b[kept]]), pa.array(share[kept])], ["u", "v", "share"])

    order = ["leaf", "i", "j"]
    dealt = dealt_blocks(placed, BLOCK, BLOCK, "sketch", "class", diagonal=True)
    found = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(lean(best), "u long, v long, share double")
    either = F.explode(F.array(F.struct("u", "v", "share"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "share")))
    mine = found.select(either.alias("e")).select("e.*").groupBy("u").agg(F.max_by("v", F.struct("share", -F.col("v"))).alias("v"))
    return mine.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _possible(placed: DataFrame, percent: int) -> DataFrame:
    """(u, v): of each list, or two blocks of it, a spanning forest of the pairs in different classes that may link."""
    def tied(batches):
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            u, v, _, left = _short_runs(batch, percent)
            if len(u):
                yield pair_batch(u, v)
            rest.append(left)
            yield from long_ones(rest, False)
        yield from long_ones(rest, True)

    def long_ones(rest: list[pa.RecordBatch], end: bool):
        for table in whole_runs(rest, end):
            run = _ListRun(table, percent)
            a, b, _ = run.likely()
            a, b = run.node[a], run.node[b]
            kept = forest(a, b)
            if kept.any():
                yield pair_batch(a[kept], b[kept])

    order = ["leaf", "i", "j"]
    return dealt_blocks(placed, BLOCK, BLOCK, "sketch", "class").repartition(*order).sortWithinPartitions(*order).mapInArrow(lean(tied), "u long, v long").distinct()


def _cells_in_common(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair: the sum of the smaller counts, one matrix product per height, and whether a cell is full in both."""
    most = np.zeros((len(left), len(right)), np.float32)
    for height in range(1, 256):
        a, b = (left >= height).astype(np.float32), (right >= height).astype(np.float32)
        used = a.any(0) & b.any(0)
        if not used.any():
            return most.astype(np.int64), np.zeros(most.shape, bool)
        level = a[:, used] @ b[:, used].T
        most += level
    return most.astype(np.int64), level > 0


def _stored_sets(rows: DataFrame, n_words: int, wanted, bits: int) -> DataFrame:
    """(node, grams, cells) of the wanted rows: the sorted hashes, and how many of them fall in each cell, 255 meaning any more."""
    def store(batches):
        for batch in batches:
            all_kept = batch.filter(pa.array(_marked(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), wanted.value, bits)))
            for at in range(0, all_kept.num_rows, ROWS):
                kept = all_kept.slice(at, ROWS)
                got = [x for _, x in _sets(kept.column(1), n_words)]
                cells = [np.minimum(np.bincount((x & np.uint64(BOUND_CELLS - 1)).astype(np.int64), minlength=BOUND_CELLS), 255).astype(np.uint8).tobytes() for x in got]
                yield pa.RecordBatch.from_arrays([kept.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary()),
                                                  pa.array(cells, pa.binary())], ["node", "size", "grams", "cells"])

    return rows.mapInArrow(lean(store), "node long, size long, grams binary, cells binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets link, by merging both sorted sets."""

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.zeros(len(left), bool)
        for k, (a, b) in enumerate(zip(left, right, strict=True)):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[k] = 100 * both >= percent * (len(a) + len(b) - both)
        give_back()
        return pd.Series(out)

    return (pairs.join(sets.withColumnsRenamed({"node": "u", "grams": "left"}), "u")
            .join(sets.withColumnsRenamed({"node": "v", "grams": "right"}), "v")
            .where(linked("left", "right")).select("u", "v").distinct())
