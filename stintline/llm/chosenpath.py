"""Near-duplicates by chosen paths: a set similarity join that recursively branches documents by minwise tokens.

* Rows of equal n-gram sets are one member. A member carries SLOTS minwise tokens, a sketch of CELLS bytes and its size.
* A tree branches every node's members by two of their minwise tokens, chosen by the node: members with the same token of the
  same slot are a child. Two sets of similarity s part at a node with chance (1 - s)^2 only, and as a pair goes on in each child
  that holds both, it is lost with a chance that does not grow to 1 with the depth (`survival`). `trees` repeats independent
  trees until the chance that a pair just at the threshold shares a leaf in none of them is below 1 - recall.
* A node is a leaf if it is small, if its members hardly part (the usual sign of a family of near copies) or at the last level.
* Members of a leaf are compared exhaustively by sketches, leaves of over BLOCK members block by block; a pair becomes a row only
  as an edge of the leaf's maximum spanning forest or as a member's pair with its leaf's leader. These pairs are confirmed on the
  full sets, and what they link is one class.
* Then each leaf that still has members of several classes is gone through again: those with a likely partner in another class
  bring their full sets, and all such pairs are judged on them inside the task, by products of incidence blocks. Only the edges
  of a spanning forest between classes leave it. So a large family costs no rows of pairs, and no link in a leaf is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintline.llm.blocks import block_runs, dealt_blocks, forest, links_between, pair_batch
from stintline.llm.blocks import overlap_matrix as _overlaps
from stintline.llm.components import components
from stintline.llm.jaccard import BITMAP_BITS, _bitmap, _marked
from stintline.llm.memory import give_back, lean
from stintline.llm.scratch import Scratch
from stintline.llm.wordhash import ROWS, grams, mix, word_runs

SLOTS = 32
CELLS = 128
LEAF = 256  # members of a node that is compared as it is
BLOCK = 512  # members of a block of a larger leaf
LEVELS = 6
STAYS = 0.7  # a child with more of its parent's members than this is a leaf
SLACK = 4.5  # standard deviations that the sketch may err below the threshold
RECALL = 0.9999

_MARK = np.uint64(0xA5A5A5A5A5A5A5A5)
_DRAW = np.random.Generator(np.random.PCG64(20250312))
_MASK = _DRAW.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_TIMES = _DRAW.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def survival(percent: int, levels: int = LEVELS) -> float:
    """The chance that a pair at the threshold still shares a node after so many levels of two branches each."""
    s, q = percent / 100, 1.0
    for _ in range(levels):
        q = 1 - (1 - s * q) ** 2
    return q


def trees(percent: int, recall: float = RECALL) -> int:
    return max(1, ceil(log(1 - recall) / log(1 - survival(percent))))


def _sketches(column: pa.Array, n_words: int) -> Iterator[tuple[list, ...]]:
    """(sizes, marks high, marks low, minwise tokens, sketches) of the sets of successive runs of texts."""
    for _, bounds, _, _, hashes in word_runs(column):
        sets = [np.unique(grams(hashes[bounds[k] : bounds[k + 1]], n_words)) for k in range(len(bounds) - 1)]
        sizes = np.array([len(x) for x in sets], np.int64)
        held = np.flatnonzero(sizes)
        tokens = np.zeros((len(sets), SLOTS), np.uint64)
        cells = np.zeros((len(sets), CELLS), np.uint8)
        high, low = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        if len(held):
            flat = np.concatenate([sets[k] for k in held])
            at = np.concatenate([[0], np.cumsum(sizes[held])[:-1]])
            for slot in range(SLOTS):
                tokens[held, slot] = np.minimum.reduceat((flat ^ _MASK[slot]) * _TIMES[slot], at)
            high[held] = np.bitwise_xor.reduceat(mix(flat ^ _MARK), at)
            low[held] = np.add.reduceat(flat, at)
            # Of the n-grams that fall in a cell the least one leaves eight bits of its hash, from 1 to 255; 0: none fell there.
            spread = mix(flat + np.uint64(0x51ED270B))
            place = np.repeat(held, sizes[held]) * CELLS + (spread & np.uint64(CELLS - 1)).astype(np.int64)
            least = np.full(len(sets) * CELLS, np.iinfo(np.uint64).max)
            np.minimum.at(least, place, spread >> np.uint64(7))
            cells = np.where(least == np.iinfo(np.uint64).max, 0, 1 + least % np.uint64(255)).astype(np.uint8).reshape(-1, CELLS)
        yield sizes.tolist(), high.view(np.int64).tolist(), low.view(np.int64).tolist(), [x.tobytes() for x in tokens], [x.tobytes() for x in cells]


def _members(rows: DataFrame, n_words: int) -> DataFrame:
    def sketch(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                columns = [list(x) for x in zip(*_sketches(part.column(1), n_words), strict=True)]
                n, high, low, tokens, cells = ([y for x in c for y in x] for c in columns)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                                                  pa.array(tokens, pa.binary()), pa.array(cells, pa.binary())], ["doc_id", "n", "high", "low", "tokens", "sketch"])

    return rows.mapInArrow(lean(sketch), "doc_id long, n long, high long, low long, tokens binary, sketch binary")


def _token(slot: Column) -> Column:
    return F.col("tokens").substr(slot * 8 + 1, F.lit(8))


def _child(tree: Column, node: Column, slot: Column) -> Column:
    return F.xxhash64(tree, node, slot, _token(slot))


def leaves(members: DataFrame, scratch: Scratch, n_trees: int, leaf: int = LEAF, levels: int = LEVELS, stays: float = STAYS) -> DataFrame:
    """(leaf, node, n, sketch, c) of the members of every leaf of over one member; c is how many it has."""
    branch = F.explode(F.expr(f"flatten(transform(sequence(0, {n_trees - 1}), t -> array(struct(t as tree, 2 * t as slot), struct(t as tree, 2 * t + 1 as slot))))"))
    begun = members.select("node", "tokens", branch.alias("b")).select("node", _child(F.col("b.tree"), F.lit(0), F.col("b.slot") % SLOTS).alias("at"))
    begun = begun.withColumn("of", F.lit(None).cast("long"))
    found = None
    for level in range(levels):
        grown = scratch.write(begun.groupBy("at").agg(F.count("*").alias("c"), F.max("of").alias("of")).where("c > 1"))
        placed = scratch.write(begun.select("at", "node").join(grown, "at"))
        scratch.drop(grown)
        last = F.lit(level == levels - 1)
        done = (F.col("c") <= leaf) | (F.col("c") > stays * F.col("of")) | last
        ends = placed.where(F.coalesce(done, F.lit(False))).select(F.col("at").alias("leaf"), "node", "c")
        found = ends if found is None else found.unionByName(ends)
        onward = placed.where(~F.coalesce(done, F.lit(False)))
        if onward.isEmpty():
            break
        # Two different slots, chosen by the node.
        slot = F.expr(f"pmod(xxhash64(at, 1), {SLOTS})")
        other = F.expr(f"pmod(pmod(xxhash64(at, 1), {SLOTS}) + 1 + pmod(xxhash64(at, 2), {SLOTS - 1}), {SLOTS})")
        begun = onward.join(members.select("node", "tokens"), "node").withColumn("slot", F.explode(F.array(slot, other))).select(
            _child(F.lit(level + 1), F.col("at"), F.col("slot")).alias("at"), "node", F.col("c").alias("of"))
    return scratch.write(found.join(members.select("node", "n", "sketch"), "node"))


class _Run:
    """The members of one (leaf, i, j), and which of its pairs (left[a], right[b]) may link by size, class and sketch."""

    def __init__(self, run: pa.Table, percent: int):
        self.run, self.percent = run, percent
        self.node, self.n, self.at = (run.column(c).to_numpy() for c in ("node", "n", "at"))
        self.of = run.column("class").to_numpy() if "class" in run.column_names else self.node
        self.sketch = np.frombuffer(b"".join(run.column("sketch").to_pylist()), np.uint8).reshape(-1, CELLS)
        i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
        self.left, self.right, self.same = np.flatnonzero(self.at == i), np.flatnonzero(self.at == j), i == j

    def likely(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, estimate) of the pairs of rows, a stretch of the left side at a time, both sides in order of size."""
        percent, parts = self.percent, []
        right = self.right[np.argsort(self.n[self.right], kind="stable")]
        sizes = self.n[right]
        cells = self.sketch[right]
        filled = cells != 0
        for start in range(0, len(self.left), 32):
            part = self.left[start : start + 32]
            low = int(np.searchsorted(100 * sizes, percent * self.n[part].min()))
            high = int(np.searchsorted(percent * sizes, 100 * self.n[part].max(), "right"))
            if low >= high:
                continue
            n, m = self.n[part, None], sizes[None, low:high]
            fit = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (self.of[part, None] != self.of[right][None, low:high])
            if self.same:
                fit &= self.node[part, None] < self.node[right][None, low:high]
            a, b = np.nonzero(fit)
            if not len(a):
                continue
            b += low
            x, y = self.sketch[part[a]], cells[b]
            used = (filled[b] | (x != 0)).sum(1)
            estimate = ((x == y) & filled[b]).sum(1) / np.maximum(used, 1)
            s = percent / 100
            keep = estimate >= s - SLACK * np.sqrt(s * (1 - s) / np.maximum(used, 1))
            parts.append((part[a[keep]], right[b[keep]], estimate[keep]))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _likely_edges(placed: DataFrame, percent: int, leaf: int, block: int) -> DataFrame:
    """(u, v): the spanning forest of likely links, best first, of each leaf or block of it, and each member with its leaf's leader."""
    def likeliest(batches):
        for table in block_runs(batches):
            run = _Run(table, percent)
            a, b, estimate = run.likely()
            order = np.argsort(-estimate, kind="stable")
            a, b = run.node[a[order]], run.node[b[order]]
            kept = forest(a, b)
            if kept.any():
                yield pair_batch(a[kept], b[kept])

    order = ["leaf", "i", "j"]
    inside = dealt_blocks(placed, leaf, block, "sketch").repartition(*order).sortWithinPartitions(*order).mapInArrow(lean(likeliest), "u long, v long")
    # Drawn by the member alone, so that the leaves of one family agree on the leader.
    large = placed.where(f"c > {leaf}")
    leader = large.groupBy("leaf").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias("l")).select("leaf", F.col("l.node").alias("v"), F.col("l.n").alias("m"))
    led = large.join(leader, "leaf").where(f"node <> v and 100 * least(n, m) >= {percent} * greatest(n, m)")
    return inside.unionByName(led.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v"))).distinct()


def _still_likely(placed: DataFrame, percent: int, leaf: int, block: int) -> DataFrame:
    """(leaf, node) of the members that have a likely partner of another class in the leaf."""
    def active(batches):
        for table in block_runs(batches):
            run = _Run(table, percent)
            a, b, _ = run.likely()
            if len(a):
                got = np.unique(np.concatenate([a, b]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), table.column("leaf")[0].as_py()), pa.int64()), pa.array(run.node[got], pa.int64())], ["leaf", "node"])

    order = ["leaf", "i", "j"]
    return (dealt_blocks(placed, leaf, block, "sketch", "class").repartition(*order).sortWithinPartitions(*order)
            .mapInArrow(lean(active), "leaf long, node long").distinct())


def _set_marks(got: np.ndarray) -> tuple[int, int]:
    return int(np.bitwise_xor.reduce(mix(got ^ _MARK)).view(np.int64)), int(got.sum(dtype=np.uint64).view(np.int64))


def _full_sets(rows: DataFrame, wanted: DataFrame, n_words: int) -> DataFrame:
    """(node, grams) of the wanted members (node, high, low): their sorted n-gram hashes.

    Which ids are wanted goes out as a bitmap of fixed size, so texts are not shuffled; what a collision lets through the join takes off.
    """
    bits = wanted.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("node"), BITMAP_BITS))

    def store(batches):
        for batch in batches:
            passed = batch.filter(pa.array(_marked(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits.value, BITMAP_BITS)))
            for at in range(0, passed.num_rows, ROWS):
                part = passed.slice(at, ROWS)
                got = [np.unique(grams(hashes[bounds[k] : bounds[k + 1]], n_words)) for _, bounds, _, _, hashes in word_runs(part.column(1)) for k in range(len(bounds) - 1)]
                high, low = zip(*(_set_marks(x) if len(x) else (0, 0) for x in got), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())],
                                                 ["node", "high", "low", "grams"])

    stored = rows.mapInArrow(lean(store), "node long, high long, low long, grams binary")
    return stored.join(wanted, ["node", "high", "low"], "left_semi").dropDuplicates(["node", "high", "low"]).select("node", "grams")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.zeros(len(left), bool)
        for k, (a, b) in enumerate(zip(left, right, strict=True)):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[k] = 100 * both >= percent * (len(a) + len(b) - both)
        give_back()
        return pd.Series(out)

    return (pairs.join(sets.withColumnsRenamed({"node": "u", "grams": "left"}), "u").join(sets.withColumnsRenamed({"node": "v", "grams": "right"}), "v")
            .where(linked("left", "right")).select("u", "v"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80, recall: float = RECALL,
                 leaf: int = LEAF, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs; component_id is the smallest id reachable by links found.

    Words are runs of non-space characters with A-Z lower-cased; a text of fewer than n_words words has its whole sequence as one
    n-gram. Null, empty and blank texts have the empty set and link with nothing. Two documents link when
    100 * |A n B| >= percent * |A u B|. Rows that repeat an id are one document, whose texts' classes are tied together; each keeps
    its row. A row without an id takes no part and has a null component and kept. An empty table gives an empty one, and other
    columns are not read. `kept` is true where the id is its class's smallest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = scratch.write(_members(rows, n_words))
    own = known.where("n > 0 and doc_id is not null")
    named = scratch.write(own.groupBy("high", "low").agg(F.min("doc_id").alias("node")))
    members = scratch.write(own.join(named, ["high", "low"]).where("doc_id = node").select("node", "n", "high", "low", "tokens", "sketch").dropDuplicates(["high", "low"]))
    member = known.select("doc_id", F.col("n").alias("n_shingles"), "high", "low").join(named, ["high", "low"], "left")
    member = scratch.write(member.select("doc_id", "n_shingles", "high", "low", F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")).alias("node")))
    # A document whose rows hold different texts ties their classes together, and as its id may name several sets, sets are keyed apart.
    several = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count_distinct("high", "low").alias("sets")).where("sets > 1")
    tied = scratch.write(member.join(several.select("doc_id"), "doc_id", "left_semi").where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct())
    scratch.drop(known, named)

    placed = leaves(members, scratch, trees(percent, recall), leaf, levels)
    pairs = scratch.write(_likely_edges(placed, percent, leaf, block))
    texts = rows.where("doc_id is not null")
    few = scratch.write(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(members.select("node", "high", "low"), "node"))
    sets = scratch.write(_full_sets(texts, few, n_words))
    edges = scratch.write(_confirmed(pairs, sets, percent).unionByName(tied).distinct())
    scratch.drop(pairs, few, sets)
    classes = components(edges, scratch)

    placed = placed.join(classes, "node", "left").select("leaf", "node", "n", "sketch", "c", F.coalesce("component", "node").alias("class"))
    mixed = placed.groupBy("leaf").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("leaf")
    placed = scratch.write(placed.join(mixed, "leaf"))
    active = scratch.write(_still_likely(placed, percent, leaf, block))
    few = scratch.write(active.select("node").distinct().join(members.select("node", "high", "low"), "node"))
    sets = scratch.write(_full_sets(texts, few, n_words))
    judged = placed.drop("c").join(active, ["leaf", "node"], "left_semi").join(sets, "node")
    between = scratch.write(links_between(judged, percent, leaf, block, _Run))
    scratch.drop(few, sets, active)
    if not between.isEmpty():
        top = components(between, scratch).toDF("component", "top")
        classes = classes.unionByName(between.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes, "node", "left_anti").select("node", F.col("node").alias("component")))
        classes = classes.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    own_class = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    out = member.join(classes, "node", "left").select("doc_id", "n_shingles", own_class.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
