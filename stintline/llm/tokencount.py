"""Counts of whole texts: token ids by version of the tokenizer, words, words with a digit, bytes."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.memory import lean
from stintline.llm.packing import word_encoder

_DIGITS, _BLANKS = b"0123456789", b" \t\n\r\x0b\x0c"
_SHAPE = bytes.maketrans(_DIGITS, b"0" * len(_DIGITS))
_OTHER = bytes(b for b in range(256) if b not in _DIGITS + _BLANKS)
FLUSH = 4096  # rows of counts a batch holds


@functools.cache
def _ranked(path: str, pattern: str):
    """A tokenizer of byte ranks, once for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str, pattern: str | None = None) -> Callable[[str], int]:
    """How many ids a text has: by a file of byte ranks (`.tiktoken`, with its pattern), else by a `tokenizers` file as packing takes."""
    if path.endswith(".tiktoken"):
        # Halves of surrogate pairs cannot stand in Spark's texts, so every text has an encoding.
        return lambda text: len(_ranked(path, pattern).encode_ordinary(text))
    encode = word_encoder(path)
    return lambda text: len(encode(text)) // 2


def counted(docs: DataFrame, tokenizers: dict[str, tuple[str, str | None]], text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """The columns `keep`, mark (SHA-256 of the text), words, digit_words, bytes and a count column for each tokenizer, by its key.

    tokenizers: {column: (path on every executor, pattern or none)}; specials of a tokenizer are ordinary text. A null text counts as empty, with 0
    everywhere; texts are whole, and one is in memory at a time beside its batch. Words are runs of bytes that are not ASCII blanks. Repeated rows,
    and rows with null ids, are counted each; other columns are not read, so their names clash with nothing.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*keep, F.sha2(text, 256).alias("mark"), text.alias("counted_text"))
    names = ["words", "digit_words", "bytes", *tokenizers]

    def count(batches):
        tell = [token_counter(*t) for t in tokenizers.values()]
        for batch in batches:
            for at in range(0, batch.num_rows, FLUSH):
                part = batch.slice(at, FLUSH)
                numbers: list[list[int]] = [[] for _ in names]
                for value in part.column(part.num_columns - 1):
                    text = value.as_py()
                    raw = text.encode()
                    figures = (len(raw.split()), len(raw.translate(_SHAPE, _OTHER).split()), len(raw), *(f(text) for f in tell))
                    for column, n in zip(numbers, figures, strict=True):
                        column.append(n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in numbers)], [*part.schema.names[:-1], *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lean(count), kept + "".join(f", `{n}` long" for n in names))
