"""Cost-balanced packing of documents into sequences of a fixed token capacity.

Every document is tokenised and cut into full pieces of the capacity, which are sequences of their own, and a rest. Rests are
dealt by a hash into shards of bounded size, and each shard packs its rests alone: longest first, each goes to the sequence of
lowest cost (linear * tokens + quadratic * tokens ** 2, summed over its pieces) that has room for it. Where none has, the
rest is cut at the roomiest sequence and goes on with what remains. A shard opens as many full sequences as its tokens fill;
what is over fills sequences whose capacities are the powers of two in it, so no sequence is padded.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.memory import give_back, lean

CAPACITY = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 1024  # projection and attention work of a token, in the same unit
SHARD_BYTES = 2 << 20  # text bytes a shard gets on average
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"


_MARKS = ".,;:!?|#$%&*()"
# How byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class WordEncoder:
    """Token ids of whole texts by a public tokenizer whose tokens never cross white space, as bytes of 16-bit ids.

    Texts are taken apart at spaces and newlines and every chunk is encoded once, then remembered; the memory is emptied when
    it holds `most` chunks, so it is bounded and never changes a result. Words of Latin-1 letters, with or without
    trailing punctuation, skip the tokenizer's regular expressions and go to its model directly: they are one pre-token.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.most = most
        self.known: dict[str, bytes] = {"": b""}
        self.letters: dict[str, bytes] = {}

    def __getitem__(self, chunk: str) -> bytes:
        ids = self._encode(chunk)
        if len(chunk) <= 64:
            if len(self.known) >= self.most:
                self.known.clear()
                self.letters.clear()
            self.known[chunk] = ids
        return ids

    def _encode(self, chunk: str) -> bytes:
        low = chunk.lower()
        head = low.rstrip(_MARKS)
        if not head.isalpha() or ord(max(head)) > 255:
            return self._direct(chunk)
        ids = self.letters.get(head)
        if ids is None:
            ids = self.letters[head] = self._model(head)
        if len(head) < len(low):
            tail = low[len(head) :]
            if tail not in self.letters:
                self.letters[tail] = self._direct(tail)
            ids += self.letters[tail]
        return ids

    def _model(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return np.array([t.id for t in self.whole.model.tokenize(spelled)], np.uint16).tobytes()

    def _direct(self, chunk: str) -> bytes:
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, np.uint16).tobytes()

    def encode(self, text: str) -> bytes:
        known = self.known
        out = []
        for chunk in text.replace("\n", " ").split(" "):
            ids = known.get(chunk)
            out.append(self[chunk] if ids is None else ids)
        return b"".join(out)


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> Callable[[str], bytes]:
    """One encoder for each Python worker, with what it remembers."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path].encode


def piece_cost(tokens: np.ndarray | int) -> np.ndarray | float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) pieces of documents of given lengths below the capacity, longest first."""
    total = int(lengths.sum())
    room = np.array([capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length()) if total % capacity >> k & 1], np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), np.int64)
    for doc in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        start, left = 0, int(lengths[doc])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            best = int(fits.argmin())
            if not np.isfinite(fits[best]):
                best = int(room.argmax())
            take = min(left, int(room[best]))
            yield doc, start, take, best, int(used[best])
            room[best] -= take
            used[best] += take
            cost[best] += piece_cost(take)
            start, left = start + take, left - take


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY,
           shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset, cost.

    tokenizer: path of a `tokenizers` file of fewer than 65,536 ids whose tokens never cross white space; it must exist on
    every executor. Each document ends with end_id, so null and empty texts are one token. Rows with equal ids are packed as
    documents of their own, null ids too, and dealt to many shards however many they are. Equal lengths are packed in the order of id and text hash. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    end = np.array([end_id], np.uint16).tobytes()

    def pieces(batches):
        encode = word_encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen: Counter = Counter()  # equal rows of this task, so that they are dealt to many shards; their order does not matter
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = encode(text) + end
                mark = zlib.crc32(ids)
                nth = seen[doc, mark]
                seen[doc, mark] += 1
                copy = f" {task} {nth}" if nth or doc is None else ""
                for at in range(0, len(ids), 2 * capacity):
                    out.append((doc, at // 2, ids[at : at + 2 * capacity], len(ids) // 2, mark, zlib.crc32(f"{doc} {at} {mark}{copy}".encode()) % shards))
                held += len(ids)
                if held > 8 << 20:
                    yield _batch(out)
                    out, held = [], 0
            yield _batch(out)

    cut = rows.mapInArrow(lean(pieces), "doc_id long, start long, ids binary, doc_tokens long, mark long, shard long")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "mark", "start"], na_position="first", ignore_index=True)
        lengths = (group.ids.str.len() // 2).to_numpy(np.int64)
        full = lengths == capacity
        place = [(k, 0, capacity, s, 0) for s, k in enumerate(np.flatnonzero(full))]
        rest = np.flatnonzero(~full)
        base = len(place)
        place += [(rest[d], start, take, base + s, at) for d, start, take, s, at in pack(lengths[rest], capacity)]
        source, start, take, seq, offset = (np.array(x, np.int64) for x in zip(*place, strict=True))
        ids = group.ids.to_numpy()
        cost = np.bincount(seq, piece_cost(take.astype(float)))
        first = int(group.shard.iloc[0]) << 32
        give_back()
        return pd.DataFrame({"doc_id": group.doc_id.astype("Int64").to_numpy()[source], "start": group.start.to_numpy()[source] + start, "length": take,
                             "ids": [np.frombuffer(ids[k], "<u2", n, 2 * a).astype("<u4").tobytes() for k, a, n in zip(source, start, take, strict=True)],
                             "doc_tokens": group.doc_tokens.to_numpy()[source], "sequence_id": first + seq, "offset": offset, "cost": cost[seq]})

    return cut.groupBy("shard").applyInPandas(fill, PIECE)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      ["doc_id", "start", "ids", "doc_tokens", "mark", "shard"])


def ids_crc32(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32, the CRC-32 of their ids as little-endian 32-bit numbers, instead of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
