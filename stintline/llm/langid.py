"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +-1. A letter trigram is bound as shift(shift(a)) * shift(b) * c, where shift rotates by one
place; a text is the bundle (sum) of its trigrams, a language the bundle of its texts. A text takes the language of the
nearest prototype by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.wordhash import mix, runs

DIMENSIONS = 512
CODES = 256  # 0 is the gap between words; a-z have codes of their own, further letters are hashed into the rest
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def _letter_codes() -> np.ndarray:
    """Code of every code point; 0 for what is not a letter."""
    if not _letters:
        points = np.arange(0x110000)
        letter = np.fromiter((chr(c).isalpha() for c in points), bool, len(points))
        codes = (mix(points.astype(np.uint64)) % np.uint64(CODES - 27)).astype(np.uint32) + 27
        codes[97:123] = np.arange(1, 27)
        _letters.append(np.where(letter, codes, 0).astype(np.uint32))
    return _letters[0]


def letter_vectors(dimensions: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(5)).integers(0, 2, (CODES, dimensions)).astype(np.int8) * 2 - 1


def bound(trigrams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Vectors of trigram codes."""
    a, b, c = trigrams // CODES**2, trigrams // CODES % CODES, trigrams % CODES
    return (np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]).astype(np.float32)


def trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, past, trigram codes, the document of each) of runs of documents; case is folded, gaps are one code."""
    table = _letter_codes()
    for first, past, data, offsets in runs(column):
        texts = [" " + data[a:b].tobytes().decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        codes = table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        doc = np.repeat(np.arange(first, past), [len(t) for t in texts])
        keep = (codes > 0) | (np.append(codes[1:], 0) > 0)  # the gap before a word stays
        codes, doc = codes[keep], doc[keep]
        if len(codes) < 2:
            continue
        # A word is read as gap, letters, gap: the gap after it is the one before the next, or the text's end.
        last = np.append(doc[1:] != doc[:-1], True)
        codes, doc = np.insert(codes, np.flatnonzero(last) + 1, 0), np.insert(doc, np.flatnonzero(last) + 1, doc[last])
        got = (codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:]
        whole = (doc[:-2] == doc[2:]) & (codes[1:-1] > 0)
        yield first, past, got[whole], doc[:-2][whole]


def prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The learned languages, sorted, and a row for each: the bundle of all its texts.

    Binding is done once for each distinct trigram: counts by language and trigram are summed map-side and then over the shuffle,
    so a hot language costs no more than another. Rows without text or language teach nothing.
    """
    def count(batches):
        for batch in batches:
            names = batch.column(1).to_pylist()
            langs = sorted(set(names))
            of = np.array([langs.index(x) for x in names], np.int64)
            seen = [np.stack(np.unique(of[doc] * CODES**3 + got, return_counts=True)) for _, _, got, doc in trigrams(batch.column(0))]
            if seen:
                keys, n = np.concatenate(seen, 1)
                keys, at = np.unique(keys, return_inverse=True)
                total = np.bincount(at, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in keys // CODES**3], pa.string()), pa.array(keys % CODES**3), pa.array(total)],
                                                 ["lang", "trigram", "n"])

    usable = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = usable.mapInArrow(count, "lang string, trigram long, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))
    letters = letter_vectors(dimensions)

    def bundle(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in groups:
            for lang, part in batch.groupby("lang"):
                sums[lang] = sums.get(lang, 0) + part.n.to_numpy(np.float64) @ bound(part.trigram.to_numpy(), letters)
        for lang, vector in sums.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(dimensions), "x": vector})

    rows = counts.mapInPandas(bundle, "lang string, dim int, x double").groupBy("lang", "dim").agg(F.sum("x").alias("x")).toPandas()
    langs = sorted(rows.lang.unique().tolist())
    out = np.zeros((len(langs), dimensions))
    out[[langs.index(x) for x in rows.lang], rows.dim] = rows.x
    return langs, out


def predicted(docs: DataFrame, langs: list[str], profiles: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; score is the cosine with the nearest prototype, at least 0.

    `und` and 0 where the text is null or has no letter, or nothing was learned. Equal cosines go to the first language by name.
    """
    dimensions = profiles.shape[1]
    unit = profiles / np.maximum(1e-12, np.linalg.norm(profiles, axis=1, keepdims=True))
    held = docs.sparkSession.sparkContext.broadcast(unit.astype(np.float32))

    def predict(batches):
        letters = letter_vectors(dimensions)
        for batch in batches:
            best = np.zeros(batch.num_rows)
            name = np.full(batch.num_rows, UNDETERMINED, object)
            for first, past, got, doc in trigrams(batch.column(1)) if langs else ():
                distinct, at = np.unique(got, return_inverse=True)
                vectors = bound(distinct, letters)
                for a in range(first, past, 64):  # documents at a time, so that the count matrix stays small
                    low, high = np.searchsorted(doc, [a, min(a + 64, past)])
                    n = min(64, past - a)
                    counts = np.bincount((doc[low:high] - a) * len(distinct) + at[low:high], minlength=n * len(distinct))
                    bundle = counts.reshape(n, -1).astype(np.float32) @ vectors
                    norm = np.linalg.norm(bundle, axis=1)
                    cosine = bundle @ held.value.T / np.maximum(norm, 1e-9)[:, None]
                    some = np.bincount(doc[low:high] - a, minlength=n) > 0
                    pick = cosine.argmax(1)
                    best[a : a + n] = np.where(some, np.clip(cosine[np.arange(n), pick], 0, 1), 0)
                    name[a : a + n] = np.where(some, np.array(langs, object)[pick], UNDETERMINED)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(best)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        predict, "doc_id long, lang_pred string, score double")
