"""Spelling variants: a bit-sliced position index over blocks of the vocabulary, and the form each word is a variant of.

* A word is counted once per text run: letters are found on the bytes of a batch, CRCs of all its runs advance together.
* Two words within one error share, on one side of the error, all their code points. With m the shorter length and
  q = (m - 1) // 2, they share the first q or the last q. Blocks of the vocabulary are therefore (m, side, those q); a word is
  in four of them. Blocks of the last q hold the words reversed, so that every block's words have a common beginning.
* In a block every (position, letter) is one bitset over its words, kept as a whole number. A word is looked up by a recurrence
  over its letters that follows the words met without an error and those met with one, by kind: replaced (same position),
  one more (position + 1), one less (position - 1). Bit 0 is the word of largest n, so the lowest set bit is the form.
* A pair of words is found in one block only: the blocks of the last q leave out the words that share the first q. So near words
  are counted by sums, and no pair of words becomes a row.
* Blocks of over PART words are dealt into parts of about PART, and every part is met by slabs of the block's words, each in
  a group of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.memory import lean
from stintline.llm.scratch import Scratch
from stintline.llm.wordhash import LOWER, hash_spans, runs

LEAST = 7  # code points of a word
SPOILED = 31  # runs whose CRC it divides lose a code point
RATIO = 10
PART = 8192  # words of an index part
SLAB = 65536  # words of a block that meet a part in one group
HELD = 1 << 17  # distinct words that a task counts before it hands them on

_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _letter_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8: the latter are the byte C3 and the one after it."""
    lead = data == 0xC3
    kind = _ASCII[data] | lead
    kind[1:] |= lead[:-1]
    edge = np.flatnonzero(np.diff(kind.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


def _crcs(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The CRC-32 of every span, carried on from the CRC of what precedes it; all spans advance a byte at a time, long ones alone."""
    state = heads ^ np.uint32(0xFFFFFFFF)
    for k in range(min(int((ends - starts).max(initial=0)), 64)):
        live = np.flatnonzero(starts + k < ends)
        now = state[live]
        state[live] = _CRC[(now ^ low[starts[live] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(ends - starts > 64):
        out[k] = zlib.crc32(low[starts[k] : ends[k]].tobytes(), int(heads[k]))
    return out


def _words(ids: list, column: pa.Array, least: int, spoiled: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """(words, how often) of successive stretches of a batch."""
    for first, past, data, offsets in runs(column):
        low = LOWER[data]
        starts, ends = _letter_runs(low)
        leads = np.concatenate([[0], np.cumsum(low == 0xC3)])
        points = ends - starts - (leads[ends] - leads[starts])
        fit = points >= least
        starts, ends, points = starts[fit], ends[fit], points[fit]
        if not len(starts):
            continue
        heads = np.array([zlib.crc32(f"{ids[k]}:".encode()) if ids[k] is not None else 0 for k in range(first, past)], np.uint32)
        owner = np.searchsorted(offsets, starts, "right") - 1
        crc = _crcs(low, starts, ends, heads[owner])
        cut = (crc % np.uint32(spoiled) == 0) & np.array([ids[k] is not None for k in range(first, past)])[owner]
        body = low.tobytes()
        spelled: dict[bytes, int] = {}
        for k in np.flatnonzero(cut & (points > least)):
            word = body[starts[k] : ends[k]].decode()
            at = int(crc[k]) % len(word)
            changed = (word[:at] + word[at + 1 :]).encode()
            spelled[changed] = spelled.get(changed, 0) + 1
        if spelled:
            yield list(spelled), list(spelled.values())
        starts, ends = starts[~cut], ends[~cut]
        if len(starts):
            _, at, times = np.unique(hash_spans(low, starts, ends), return_index=True, return_counts=True)
            yield [body[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], times.tolist()


def _counted(held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, spoiled: int = SPOILED) -> DataFrame:
    """(word, n) of all words of the texts, of at least `least` code points and two occurrences.

    A text without an id has no CRC, so none of its runs loses a code point. Null and empty texts have no runs.
    """
    def count(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for words, times in _words(batch.column(0).to_pylist(), batch.column(1), least, spoiled):
                for word, n in zip(words, times, strict=True):
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield _counted(held)
                    held = {}
        if held:
            yield _counted(held)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")


class PositionIndex:
    """Bitsets by (position, letter) over some words; `near` gives the bitset of the words within exactly one error of a word."""

    def __init__(self, words: list[str]):
        self.all = (1 << len(words)) - 1
        self.at: list[dict[str, int]] = []
        self.sized: dict[int, int] = {}
        for k, word in enumerate(words):
            bit = 1 << k
            self.sized[len(word)] = self.sized.get(len(word), 0) | bit
            while len(self.at) <= len(word):
                self.at.append({})
            for letters, letter in zip(self.at, word, strict=False):
                letters[letter] = letters.get(letter, 0) | bit

    def near(self, word: str, shared: int = 0) -> int:
        """`shared`: how many first letters all indexed words have in common with the word."""
        at, size = self.at, len(word)
        none: dict[str, int] = {}
        met, replaced, more, less = self.all, 0, 0, 0
        for i in range(shared, size):
            letter = word[i]
            here = at[i].get(letter, 0) if i < len(at) else 0
            after = at[i + 1] if i + 1 < len(at) else none
            more = (more | met) & after.get(letter, 0)
            less = (less & at[i - 1].get(letter, 0) if less and 0 < i <= len(at) else 0) | met
            replaced = (replaced & here) | (met & ~here)
            met &= here
            if not (met or replaced or more or less):
                return 0
        return replaced & self.sized.get(size, 0) | (more | met) & self.sized.get(size + 1, 0) | less & self.sized.get(size - 1, 0)


def _lookups(block: pa.Table) -> Iterator[tuple[str, int, str, int]]:
    """(word, near words, best of them, its n) of every word looked up in a group of rows with one key and part."""
    m, side, q = block.column("m")[0].as_py(), block.column("side")[0].as_py(), (block.column("m")[0].as_py() - 1) // 2
    words, n = block.column("word").to_pylist(), block.column("n").to_pylist()
    held, asked = block.column("held").to_pylist(), block.column("asked").to_pylist()
    order = sorted((k for k, h in enumerate(held) if h), key=lambda k: (-n[k], words[k]))
    turned = (lambda w: w[::-1]) if side else (lambda w: w)
    index = PositionIndex([turned(words[k]) for k in order])
    base = index.sized.get(m, 0)
    begun: dict[str, int] = {}
    if side:
        for bit, k in enumerate(order):
            begun[words[k][:q]] = begun.get(words[k][:q], 0) | 1 << bit
    for k, ask in enumerate(asked):
        if not ask:
            continue
        found = index.near(turned(words[k]), q)
        if len(words[k]) > m:
            found &= base  # two longer words meet in the blocks of their own length
        if side:
            found &= ~begun.get(words[k][:q], 0)
        if found:
            best = order[(found & -found).bit_length() - 1]
            yield words[k], found.bit_count(), words[best], n[best]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that follow each other with equal keys, which may go on over several batches."""
    carry: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            changed |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:], strict=False):
            key = tuple(c[start].as_py() for c in columns)
            if carry and key != last:
                yield pa.Table.from_batches(carry)
                carry = []
            carry.append(batch.slice(start, end - start))
            last = key
    if carry:
        yield pa.Table.from_batches(carry)


def near_words(words: DataFrame, part: int = PART, slab: int = SLAB) -> DataFrame:
    """(word, n_near, form, form_n) of every word with near words; form is the near word of largest n, ties by code points."""
    size = F.length("word")
    m = F.explode(F.array(size, size - 1)).alias("m")
    laid = words.select("word", "n", m).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), F.expr("(m - 1) div 2").cast("int").alias("q"))
    laid = laid.select("word", "n", "m", "side", F.when(F.col("side") == 0, F.expr("left(word, q)")).otherwise(F.expr("right(word, q)")).alias("ends"))
    key = ["m", "side", "ends"]
    large = laid.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > part).select(
        *key, F.ceil(F.col("c") / part).cast("int").alias("parts"), F.ceil(F.col("c") / slab).cast("int").alias("slabs"))
    laid = laid.join(large, key, "left")
    own = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.expr("pmod(xxhash64(word), parts)")).cast("int")
    asks = F.when(F.col("slabs").isNull(), F.lit(0)).otherwise(F.expr("pmod(xxhash64(word, 1), slabs)")).cast("int")
    laid = laid.withColumn("own", own).withColumn("asks", asks)
    # In a small block one row is held and asked; in a large one a row goes to each part it asks and each slab that asks it.
    places = F.expr("""if(parts is null, array(named_struct('i', 0, 'j', 0, 'held', true, 'asked', true)),
        concat(transform(sequence(0, parts - 1), x -> named_struct('i', x, 'j', asks, 'held', x = own, 'asked', true)),
               transform(filter(sequence(0, slabs - 1), y -> y <> asks), y -> named_struct('i', own, 'j', y, 'held', true, 'asked', false))))""")
    dealt = laid.select(*key, "word", "n", F.explode(places).alias("p")).select(*key, "p.i", "p.j", "p.held", "p.asked", "word", "n")
    group = [*key, "i", "j"]

    def look(batches):
        out: list[tuple] = []
        for block in _groups(batches, group):
            if block.num_rows > 1:
                out.extend(_lookups(block))
            if len(out) > 20000:
                yield _found(out)
                out = []
        if out:
            yield _found(out)

    found = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(lean(look), "word string, n_near long, form string, form_n long")
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.*")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
                                      ["word", "n_near", "form", "form_n"])


def variant_groups(words: DataFrame, ratio: int = RATIO, part: int = PART, slab: int = SLAB) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a table (word, n) of distinct words of at least three code points.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least `ratio` times its own;
    the root is the last form reached from it, itself if it has none. An empty table gives an empty one; rows with a null word or n
    are left out; other columns are not read.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.write(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where("word is not null and n is not null"))
    near = near_words(words, part, slab)
    kept = F.col("form_n") >= ratio * F.col("n")
    told = scratch.write(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(kept, F.col("form")).alias("form"), F.when(kept, F.col("form_n")).alias("form_n")))
    # Each step doubles the length of the chains that are followed: forms grow by the ratio, so a few steps do.
    roots = scratch.write(told.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        moved = scratch.write(moved)
        scratch.drop(roots)
        roots = moved.select("word", "root")
        roots._scratch_path = moved._scratch_path
        if moved.where("went").isEmpty():
            break
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
