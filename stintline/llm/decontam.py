"""Benchmark decontamination: exact phrases and near matches of benchmark windows by positional inverted indexes.

The index is distributed by document: every block of documents (an Arrow batch) gets its own postings, from the terms of the
benchmark to (document, position), sorted by term. A window's terms are looked up in that index; the shortest list, of its
rarest term there, gives the candidate starts (position minus the term's offset in the window), and the other terms' lists,
rarest first, are intersected with them after the same shift. A block's index depends on the block alone, so no posting is
shuffled and a hot source or passage is spread as its documents are. The benchmark goes to the tasks in chunks of bounded size,
and a task searches its documents for one chunk after the other, so a row keeps its matches whatever its id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.memory import lean
from stintline.llm.scratch import Scratch
from stintline.llm.wordhash import ALNUM, word_runs, words

WINDOW = 13
CHUNK_CHARS = 1_000_000  # benchmark characters that are searched at once, about
NEAR_TERMS = 10  # of a window's distinct words, those that a near match needs
NEAR_SLAB = 1 << 20  # places of rare terms tried at once, about
MATCH = "array<struct<item_id:string,start:long,length:long,kind:string>>"


def _windows(items: list[tuple[str, np.ndarray]], width: int) -> list[tuple[list[str], np.ndarray]]:
    """By window length: (item ids, matrix of term hashes, a row for each distinct window of an item)."""
    by_length: dict[int, tuple[list[str], list[np.ndarray]]] = {}
    for item, terms in items:
        size = min(width, len(terms))
        if size:
            ids, rows = by_length.setdefault(size, ([], []))
            for row in np.unique(np.lib.stride_tricks.sliding_window_view(terms, size), axis=0):
                ids.append(item)
                rows.append(row)
    return [(ids, np.stack(rows)) for ids, rows in by_length.values()]


class PositionalIndex:
    """Postings of chosen terms over one stretch of consecutive word hashes."""

    def __init__(self, hashes: np.ndarray, vocabulary: np.ndarray):
        """vocabulary: sorted distinct term hashes; all others have no list and code -1."""
        slot = np.searchsorted(vocabulary, hashes)
        slot[slot == len(vocabulary)] = 0
        self.codes = np.where(vocabulary[slot] == hashes, slot, -1).astype(np.int32) if len(vocabulary) else np.full(len(hashes), -1, np.int32)
        at = np.flatnonzero(self.codes >= 0)
        at = at[np.argsort(self.codes[at], kind="stable")]
        self.positions = at
        self.counts = np.bincount(self.codes[at], minlength=len(vocabulary))
        self.begins = np.concatenate([[0], np.cumsum(self.counts)])

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window row, start) of every place where all terms of a window stand in its order."""
        lengths = self.counts[windows]
        rarest_first = np.argsort(lengths, axis=1, kind="stable")
        live = np.flatnonzero(lengths.min(1) > 0)
        if not len(live):
            return live, live
        offset = rarest_first[live, 0]
        term = windows[live, offset]
        size = self.counts[term]
        row = np.repeat(live, size)
        within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        start = self.positions[np.repeat(self.begins[term], size) + within] - np.repeat(offset, size)
        fits = (start >= 0) & (start + windows.shape[1] <= len(self.codes))
        row, start = row[fits], start[fits]
        for k in range(1, windows.shape[1]):
            offset = rarest_first[row, k]
            same = self.codes[start + offset] == windows[row, offset]
            row, start = row[same], start[same]
        return row, start

    def near(self, terms: np.ndarray, sizes: np.ndarray, least: int, slack: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window row, position) of a window's rarest terms where `least` or more of its terms stand within slack words, in one document.

        terms: a row of distinct terms for each window, rarest first, sizes of them. Where `least` of n terms stand, one of the n - least + 1
        rarest does, so only their places are tried.
        """
        n = len(self.codes) + 1
        keys = self.codes[self.positions].astype(np.int64) * n + self.positions
        rows, places = [], []
        for k in range(max(0, int(sizes.max(initial=0)) - least + 1)):
            live = np.flatnonzero((k <= sizes - least) & (self.counts[terms[:, k]] > 0))
            ends = np.cumsum(self.counts[terms[live, k]])
            for part in np.split(live, np.flatnonzero(np.diff(ends // NEAR_SLAB)) + 1):
                term = terms[part, k]
                size = self.counts[term]
                row = np.repeat(part, size)
                at = self.positions[np.repeat(self.begins[term], size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
                doc = np.searchsorted(bounds, at, "right") - 1
                low, high = np.maximum(at - slack, bounds[doc]), np.minimum(at + slack, bounds[doc + 1] - 1)
                spare = sizes[row] - least
                for j in range(terms.shape[1]):
                    if not len(row):
                        break
                    wanted = terms[row, j].astype(np.int64) * n
                    found = keys[np.minimum(np.searchsorted(keys, wanted + low), len(keys) - 1)]
                    spare -= (j < sizes[row]) & ~((wanted + low <= found) & (found <= wanted + high))
                    row, at, low, high, spare = (x[spare >= 0] for x in (row, at, low, high, spare))
                rows.append(row)
                places.append(at)
        return (np.concatenate(rows), np.concatenate(places)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _rarest_first(windows: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each window by rank, and how many they are; what stands after them in a row is no term of their own."""
    ranks = np.sort(rank[windows], axis=1)
    again = np.zeros(ranks.shape, bool)
    again[:, 1:] = ranks[:, 1:] == ranks[:, :-1]
    order = np.argsort(again, axis=1, kind="stable")
    return np.argsort(rank)[np.take_along_axis(ranks, order, 1)], (~again).sum(1)


def postings(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, positions) of the given terms: the index as a table, for a caller who keeps one between runs."""
    hashes = {t: int(words(np.frombuffer(t.encode(), np.uint8), ALNUM)[2][0]) for t in terms}
    vocabulary = np.array(sorted(hashes.values()), np.uint64)
    names = [t for t, _ in sorted(hashes.items(), key=lambda x: x[1])]

    def make(batches):
        for batch in batches:
            out = []
            for first, bounds, _, _, got in word_runs(batch.column(1), ALNUM):
                for k in range(len(bounds) - 1):
                    index = PositionalIndex(got[bounds[k] : bounds[k + 1]], vocabulary)
                    out += [(names[t], batch.column(0)[first + k].as_py(), index.positions[index.begins[t] : index.begins[t + 1]].tolist())
                            for t in np.flatnonzero(index.counts)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()),
                                              pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["term", "doc_id", "positions"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        make, "term string, doc_id long, positions array<long>")


def benchmark_chunks(items: DataFrame, width: int = WINDOW, most: int = CHUNK_CHARS):
    """The benchmark as (vocabulary, windows by length), each from about `most` characters at most, whatever their item ids.

    Items are hashed by Spark, long ones in pieces that overlap by a window less a word; the driver holds one chunk at a time.
    """
    chars = items.agg(F.sum(F.length("text"))).first()[0]
    n = max(1, -(-(chars or 0) // most))
    piece = max(width, most // 8)

    def hashed(batches):
        for batch in batches:
            out = []
            for item, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = words(np.frombuffer((text or "").encode(), np.uint8), ALNUM)[2]
                for k, at in enumerate(range(0, max(len(terms) - width + 1, min(1, len(terms))), piece)):
                    out.append((item, (part + k) % n, terms[at : at + piece + width - 1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()),
                                              pa.array([x[2] for x in out], pa.binary())], ["item_id", "part", "terms"])

    scratch = Scratch(items.sparkSession)
    pieces = scratch.write(items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("part")).mapInArrow(
        hashed, "item_id string, part long, terms binary"))
    for k in range(n):
        got = [(r.item_id, np.frombuffer(r.terms, np.uint64)) for r in pieces.where(F.col("part") == k).collect()]
        vocabulary = np.unique(np.concatenate([t for _, t in got])) if got else np.zeros(0, np.uint64)
        yield vocabulary, [(ids, np.searchsorted(vocabulary, m)) for ids, m in _windows(got, width)]
    scratch.drop(pieces)


def _each(chunks: list):
    """The held values one after the other; of several only one stays in the worker."""
    for k, held in enumerate(chunks):
        yield k, held.value
        if len(chunks) > 1:
            vars(held).pop("_value", None)


def _ranks(rows: DataFrame, chunks: list) -> list:
    """By chunk, held: the place of each term of its vocabulary by how often it stands in all documents, then by its hash."""
    def count(batches):
        for batch in batches:
            for k, (vocabulary, _) in _each(chunks):
                total = np.zeros(len(vocabulary), np.int64)
                for _, _, _, _, hashes in word_runs(batch.column(1), ALNUM):
                    total += PositionalIndex(hashes, vocabulary).counts
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(total[at])], ["chunk", "slot", "n"])

    spark = rows.sparkSession
    scratch = Scratch(spark)
    counts = scratch.write(rows.mapInArrow(lean(count), "chunk long, slot long, n long").groupBy("chunk", "slot").agg(F.sum("n").alias("n")))
    out = []
    for k, held in enumerate(chunks):
        total = np.zeros(len(held.value[0]), np.int64)
        got = counts.where(F.col("chunk") == k).toPandas()
        total[got.slot.to_numpy(np.int64)] = got.n.to_numpy(np.int64)
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(total, kind="stable")] = np.arange(len(total))
        out.append(spark.sparkContext.broadcast(rank))
    scratch.drop(counts)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW,
                  near_terms: int = 0, slack: int = 20, most: int = CHUNK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, matches, and the columns `keep`) of every row; matches: item_id, start, length in words, kind `phrase` or `near`.

    Words are runs of letters, digits and all characters above U+007F, A-Z lower-cased. A window is `width` consecutive words
    of an item, or a shorter item whole. Adjacent phrase windows of one item are given as one longer match. near_terms > 1 also
    gives the places of a window's rarest words, by their counts over all documents, where that many of its distinct words or more
    stand within slack words, in any order; windows of fewer distinct words have none. Null and empty texts have no words and no
    matches; every row stays a row of its own, whatever its id; items without words match nothing; items with the same id, or with
    none, count as one. Results do not depend on `most`, the characters of the benchmark that are searched at once.
    """
    spark = docs.sparkSession
    others = [c for c in keep if c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *others)
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    chunks = [spark.sparkContext.broadcast(x) for x in benchmark_chunks(items, width, most)]
    ranks = _ranks(rows, chunks) if near_terms > 1 else []
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = [c for c in rows.columns[1:] if c != "text" or text_col in keep]
    schema = ", ".join(["doc_id long", "n_words long", f"matches {MATCH}", *(f"`{c}` {kinds[c]}" for c in kept)])
    return rows.mapInArrow(lean(_matcher(chunks, ranks, near_terms, slack, kept)), schema)


def _matcher(chunks: list, ranks: list, near_terms: int, slack: int, kept: list[str]):
    def match(batches):
        ordered: dict = {}
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            out: list[tuple] = []
            for k, (vocabulary, windows) in _each(chunks):
                near = ordered.get(k)
                if ranks and near is None:
                    near = [_rarest_first(rows, ranks[k].value) for _, rows in windows]
                    if len(chunks) == 1:
                        ordered[k] = near
                    else:
                        vars(ranks[k]).pop("_value", None)
                for first, bounds, _, _, hashes in word_runs(batch.column(1), ALNUM):
                    sizes[first : first + len(bounds) - 1] = np.diff(bounds)
                    index = PositionalIndex(hashes, vocabulary)
                    got: list[tuple] = []
                    for g, (ids, rows) in enumerate(windows):
                        row, at = index.phrases(rows)
                        doc = np.searchsorted(bounds, at, "right") - 1
                        inside = at + rows.shape[1] <= bounds[doc + 1]  # not across two documents
                        got += _hits(first, bounds, doc[inside], at[inside], row[inside], ids, rows.shape[1], "phrase")
                        if ranks:
                            row, at = index.near(*near[g], near_terms, slack, bounds)
                            got += _hits(first, bounds, np.searchsorted(bounds, at, "right") - 1, at, row, ids, 1, "near")
                    out += _merged(got)
            out = sorted(_merged(out) if len(chunks) > 1 else out, key=lambda x: (x[0], x[3], *_named(x[4]), x[1]))
            ends = np.searchsorted([x[0] for x in out], np.arange(batch.num_rows + 1)).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array([x[4] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()),
                                                 pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.string())],
                                                ["item_id", "start", "length", "kind"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), struct),
                                              *(batch.column(c) for c in kept)], ["doc_id", "n_words", "matches", *kept])

    return match


def _named(item: str | None) -> tuple[bool, str]:
    return item is not None, item or ""


def _hits(first, bounds, doc, at, row, ids, length, kind) -> list[tuple]:
    """(row of the batch, start, length, kind, item id) of every hit, equal ones once."""
    return list({(first + d, p, length, kind, ids[r]) for d, p, r in zip(doc.tolist(), (at - bounds[doc]).tolist(), row.tolist(), strict=True)})


def _merged(hits: list[tuple]) -> list[tuple]:
    """Overlapping or touching hits of one item and kind in one document as one."""
    spans: list[list] = []
    for d, start, length, kind, item in sorted(hits, key=lambda x: (x[0], x[3], *_named(x[4]), x[1])):
        last = spans[-1] if spans else None
        if last and (last[0], last[3], last[4]) == (d, kind, item) and start <= last[1] + last[2]:
            last[2] = max(last[2], start + length - last[1])
        else:
            spans.append([d, start, length, kind, item])
    return [tuple(x) for x in spans]
