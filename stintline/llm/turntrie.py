"""The prefix trie of conversations as a burst trie: containers of suffixes under trie heads, oversized ones burst by next turn id.

* A turn is its id, a 128-bit fingerprint of role and text, and the code points of its text; a conversation is one row with the ids
  of its turns in order. Texts are read once and never shuffled.
* Conversations of equal turns are one member with a weight. Their conv_ids are hashed in ascending order as a stream, so such a
  group may be of any size.
* At first the root holds all members in one container. While containers of more than `container` turns (and of more than one
  member) are left, each of them becomes a trie head, and its members go on, by the id of their next turn, to the containers of its
  children. A level is one aggregation with a map-side combine and one join, whatever the sizes of the containers.
* The remaining containers are dealt to tasks; each is sorted and swept once, with the open nodes on a stack. The totals of its
  top go to every head above it by a sum.

A task holds one container, thus at most `container` turns or the ids of one conversation (24 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.memory import lean
from stintline.llm.scratch import Scratch

CONTAINER = 4096  # turns of a container that is swept as it is
ID = 16  # bytes of a turn id
EMPTY = hashlib.sha256(b"").hexdigest()


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) of every conversation: the ids of its turns in one binary, and the code points of their texts.

    Order is by turn, null first; rows of one turn number go by role and then by id. Null roles and texts are empty.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").isNotNull().alias("later"), F.col("turn").cast("long").alias("turn"), role.alias("role"), mark.alias("mark"), F.length(text).cast("long").alias("size")).alias("t"))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.unhex(F.array_join(F.col("t.mark"), "")).alias("path"), F.col("t.size").alias("sizes"))


def branched(convs: DataFrame, every: int = 100, branches: int = 6) -> DataFrame:
    """Each conversation c as a branch of conversation c - c mod `every`: that one's first h turns, then c's own after its first h.

    h is the unsigned CRC-32 of the decimal c, modulo `branches`. Negative ids are taken to the next lower multiple.
    """
    base = convs.where(F.pmod("conv_id", F.lit(every)) == 0).toDF("base", "base_path", "base_sizes")
    both = convs.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(every))).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % branches)
    both = both.join(base, "base", "left").withColumn("h", F.col("h").cast("int"))
    path = F.concat(F.coalesce(F.expr(f"substr(base_path, 1, {ID} * h)"), F.lit(b"")), F.expr(f"substr(path, {ID} * h + 1)"))
    sizes = F.concat(F.coalesce(F.expr("slice(base_sizes, 1, h)"), F.expr("array()").cast("array<bigint>")), F.expr("slice(sizes, h + 1, greatest(size(sizes) - h, 0))"))
    return both.select("conv_id", path.alias("path"), sizes.alias("sizes"))


def _ends(same: DataFrame, counts: DataFrame) -> DataFrame:
    """(rep, ends_sha256) of every group of equal conversations: the SHA-256 of their ids, ascending, comma-joined."""
    def streamed(batches):
        last, rep, digest = None, None, None
        for batch in batches:
            reps, hashes = [], []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != last:
                    if digest is not None:
                        reps.append(rep)
                        hashes.append(digest.hexdigest())
                    last, rep, digest = key, conv, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(hashes, pa.string())], ["rep", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["rep", "ends_sha256"])

    alone = counts.where("weight = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ends_sha256"))
    several = same.join(counts.where("weight > 1").select("key"), "key", "left_semi").select("key", "conv_id")
    return alone.unionByName(several.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(lean(streamed), "rep long, ends_sha256 string"))


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each container; they follow each other, perhaps over several batches."""
    held: list[dict] = []
    for batch in batches:
        at = batch.column(batch.schema.get_field_index("at"))
        bounds = [0, *(np.flatnonzero(pc.not_equal(at.slice(1), at.slice(0, max(len(at) - 1, 0))).to_numpy(zero_copy_only=False)) + 1).tolist(), len(at)] if len(at) else [0]
        for start, end in zip(bounds, bounds[1:], strict=False):
            rows = batch.slice(start, end - start).to_pylist()
            if held and held[0]["at"] != rows[0]["at"]:
                yield held
                held = []
            held += rows
    if held:
        yield held


def sweep(members: list[tuple[bytes, list[int], int, int]], top: int) -> list[list]:
    """The nodes below (and with) a common beginning of `top` turns, of members (path, sizes, rep, weight) with distinct paths.

    A node is [conv_id, depth, place of its parent or None, n_convs, n_children, n_leaves, saved_tokens, rep that ends there or None];
    the first is the top.
    """
    nodes: list[list] = []
    open_: list[int] = []  # places of the nodes from the top to the last member's end

    def close(depth: int) -> None:
        while len(open_) > depth - top:
            k = open_.pop()
            node = nodes[k]
            node[5] = node[5] or 1
            node[6] += (node[3] - 1) * node[8]
            if open_:
                up = nodes[open_[-1]]
                up[0] = min(up[0], node[0])
                up[3] += node[3]
                up[4] += 1
                up[5] += node[5]
                up[6] += node[6]

    before = b""
    for path, sizes, rep, weight in sorted(members, key=lambda m: m[0]):
        length = len(path) // ID
        shared = top
        if open_:
            most = min(length, len(before) // ID)
            while shared < most and path[ID * shared : ID * shared + ID] == before[ID * shared : ID * shared + ID]:
                shared += 1
            close(shared + 1)
        for depth in range(top + len(open_), length + 1):
            nodes.append([rep, depth, open_[-1] if open_ else None, 0, 0, 0, 0, None, sizes[depth - 1] if depth else 0])
            open_.append(len(nodes) - 1)
        end = nodes[open_[-1]]
        end[0], end[3], end[7] = min(end[0], rep), end[3] + weight, rep
        before = path
    close(top)
    return [node[:8] for node in nodes]


_SWEPT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, above array<binary>")
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _containers(batches):
        top, parent, above = rows[0]["depth"], rows[0]["parent_conv_id"], rows[0]["above"]
        nodes = sweep([(r["path"], r["sizes"], r["rep"], r["weight"]) for r in rows], top)
        columns = [list(c) for c in zip(*nodes, strict=True)]
        columns[2] = [parent if p is None else nodes[p][0] for p in columns[2]]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([above, *[None] * (len(nodes) - 1)], pa.list_(pa.binary()))], [*_NODE, "above"])


def prefix_trie(sequences: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The nodes of the trie of the sequences (conv_id, path, sizes) of distinct non-null ids, the textless root (depth 0) included.

    Of each node: conv_id (its smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes
    of its subtree, itself included), saved_tokens (over its subtree, (n_convs - 1) times the code points of the node's last text)
    and ends_sha256 (of the ids of its members that have no more turns, ascending, comma-joined; of nothing where there are none).
    A sequence without turns is a member of the root only. An empty table has no nodes. Other columns are not read.
    """
    scratch = Scratch(sequences.sparkSession)
    same = scratch.write(sequences.select("conv_id", "path", "sizes", F.unhex(F.md5("path")).alias("key")))
    counts = scratch.write(same.groupBy("key").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")))
    ends = _ends(same, counts)
    now = same.join(counts, "key").where("conv_id = rep").select(
        F.lit(b"").alias("at"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.expr("array()").cast("array<binary>").alias("above"), "rep", "weight", "path", "sizes")

    left, heads, children = None, None, None
    while True:
        now = scratch.write(now)
        ended = F.length("path") == ID * F.col("depth")
        stats = scratch.write(now.groupBy("at").agg(
            F.count("*").alias("members"), F.sum(F.length("path") / ID - F.col("depth")).alias("turns"), F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"),
            F.first("depth").alias("depth"), F.first("parent_conv_id").alias("parent_conv_id"), F.first("above").alias("above"),
            F.max(F.when(F.col("depth") > 0, F.expr("get(sizes, cast(depth - 1 as int))")).otherwise(F.lit(0))).alias("size"), F.max(F.when(ended, F.col("rep"))).alias("ends")))
        child = stats.where("size(above) > 0").select(F.element_at("above", -1).alias("at"))
        children = child if children is None else children.unionByName(child)
        big = stats.where(F.col("turns") > container).where("members > 1")
        if big.isEmpty():
            left = now if left is None else left.unionByName(now)
            break
        heads = big if heads is None else heads.unionByName(big)
        known = now.join(big.select("at", F.col("conv_id").alias("head")), "at", "left")
        small = known.where("head is null").drop("head")
        left = small if left is None else left.unionByName(small)
        mark = F.expr(f"substr(path, cast({ID} * depth + 1 as int), {ID})")
        now = known.where("head is not null").where(~ended).select(
            F.unhex(F.md5(F.concat("at", mark))).alias("at"), (F.col("depth") + 1).alias("depth"), F.col("head").alias("parent_conv_id"),
            F.concat("above", F.array("at")).alias("above"), "rep", "weight", "path", "sizes")

    swept = left.repartition("at").sortWithinPartitions("at").mapInArrow(lean(_swept), _SWEPT)
    if heads is not None:
        swept = scratch.write(swept)
        own = heads.select(F.explode(F.concat("above", F.array("at"))).alias("at"), F.lit(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
        tops = swept.where("above is not null").select(F.explode("above").alias("at"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        totals = own.unionByName(tops).groupBy("at").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        grown = heads.join(children.groupBy("at").agg(F.count("*").alias("n_children")), "at").join(totals, "at")
        swept = swept.select(*_NODE).unionByName(grown.select(*_NODE))
    out = swept.join(ends.withColumnRenamed("rep", "ends"), "ends", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The prefix trie of the branched conversations (see `branched`) of a table (conv_id, turn, role, text).

    Rows without a conv_id take no part; repeated rows are turns of their own; other columns are not read.
    """
    scratch = Scratch(turns.sparkSession)
    return prefix_trie(branched(scratch.write(in_order(turns))), container)
