"""Toxicity by a weighted lexicon: folded text, one Aho-Corasick pass, exception phrases, a score normalised by length.

Folding: compatibility forms and accents are removed, look-alike letters of other scripts become Latin, digits and signs that
stand for letters are read as such where a letter follows, everything else between words is one space. A word that ends in such
digits or signs (``hell0``) has a second reading in which they are letters too, and the longer match of the two counts; a final
``!`` is a mark in both. A lexicon entry is a word beginning or a whole word with its space(s), and a weight. Exception phrases are longer: an entry found inside one of
them does not count.
"""

from __future__ import annotations

import functools
import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.scratch import Scratch

SAMPLE = 20_000  # labelled documents the lexicon is learned from, at most
CANDIDATES = 300_000  # entries considered, those in most toxic documents
EXCEPTIONS = 10_000  # phrases learned, those in most clean documents
SHORTEST, LONGEST = 3, 12  # letters of a word beginning
LEAST_SUPPORT = 3  # toxic documents an entry is seen in
LEAST_GAIN = 2.0  # documents, weighed by how often they are caught already, that an entry must still catch
LEAST_ODDS = 2.0  # log-odds of an entry

# Letters of other scripts that look like Latin ones, and what digits and signs stand for.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ӏ": "l", "օ": "o",
}
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"}

_alike = str.maketrans(LOOK_ALIKE)
_digits = str.maketrans(DIGIT_LETTERS)
_stands_for = re.compile(r"[013457 8@$!€]".replace(" ", "") + r"+(?=[^\W\d_])")
_stands_last = re.compile(r"(?<=[^\W\d_])[0134578@$€]++(?!\w)")
_between = re.compile(r"[\W\d_]+")
_invisible = re.compile("[­​-‏⁠﻿]")


def readings(text: str | None) -> tuple[str, str]:
    """The text as folded words between single spaces, with one before and one after; two spaces where there are none.

    The second reading has as many words, and differs where one ends in digits or signs; it is empty where none does.
    """
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _invisible.sub("", text)).translate(_alike)
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    text = _stands_for.sub(lambda m: m[0].translate(_digits), text)
    ended = _stands_last.sub(lambda m: m[0].translate(_digits), text)
    return _spaced(text), _spaced(ended) if ended != text else ""


def _spaced(text: str) -> str:
    return f" {_between.sub(' ', text).strip()} "


def folded(text: str | None) -> str:
    """The first reading alone."""
    return readings(text)[0]


@dataclass
class Lexicon:
    """Weights by entry, exception phrases, and the two numbers that turn a normalised sum into a chance."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -3.0
    slope: float = 1.0

    def matcher(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), 0.0))
        machine.make_automaton()
        return machine

    def total(self, machine: ahocorasick.Automaton, text: str, second: str = "") -> float:
        """The normalised sum of a folded text: of the entries at a place the longest counts, none inside an exception.

        Where the second reading has another word, the longer entry of the two counts.
        """
        if not len(machine):
            return 0.0
        found = self._counted(machine, text)
        if second:
            other, here, there = self._counted(machine, second), 0, 0
            for word, again in zip(text.split(), second.split(), strict=True):
                if word != again and there in other and other[there][0] > found.get(here, (0, 0.0))[0]:
                    found[here] = other[there]
                here, there = here + len(word) + 1, there + len(again) + 1
        return sum(weight for _, weight in found.values()) / np.sqrt(text.count(" "))

    @staticmethod
    def _counted(machine: ahocorasick.Automaton, text: str) -> dict[int, tuple[int, float]]:
        """(size, weight) of the longest entry by its place, without those inside an exception."""
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in machine.iter(text):
            begin = end - size + 1
            if weight == 0.0:
                spared.append((begin, end))
            elif size > best.get(begin, (0, 0.0))[0]:
                best[begin] = (size, weight)
        # One sweep from left to right: the farthest end of the exceptions begun so far tells whether an entry lies inside one.
        spared.sort(reverse=True)
        found, reach = {}, -1
        for begin, (size, weight) in sorted(best.items()):
            while spared and spared[-1][0] <= begin:
                reach = max(reach, spared.pop()[1])
            if begin + size - 1 > reach:
                found[begin] = (size, weight)
        return found

    def chance(self, total: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.slope * total, -35, 35))))


def entries(text: str) -> set[str]:
    """What of a folded text could be a lexicon entry: beginnings of its words and whole words."""
    return {e for word in set(text.split()) for e in _entries_of(word)}


@functools.lru_cache(50_000)
def _entries_of(word: str) -> tuple[str, ...]:
    return *(f" {word[:k]}" for k in range(SHORTEST, min(LONGEST, len(word)) + 1)), f" {word} "


def learn(labelled: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from (text, label) rows, a bounded sample, label 1 toxic.

    Documents with an entry are counted by Spark, in toxic ones first and, of what they hold, in clean ones. Then entries are taken one by one, each for what it adds in documents that none before it has caught, so the lexicon is
    short. Phrases of an entry with the word before or after it, seen in several clean and no toxic documents, become
    exceptions beside the given ones. Without toxic
    rows the lexicon is empty and scores everything low.
    """
    scratch = Scratch(labelled.sparkSession)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([readings(t) for t in batch.text], columns=["text", "second"]).assign(label=batch.label.to_numpy())

    given = labelled.select(F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"))
    rows = scratch.write(given.repartition(SAMPLE // 1000).mapInPandas(fold, "text string, second string, label int"))

    def of_toxic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter(e for text in batch.text for e in entries(text))
            yield pd.DataFrame({"entry": list(seen), "n": list(seen.values())})

    def of_clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = held.value
        for batch in batches:
            seen = Counter(e for text in batch.text for e in entries(text) if e in wanted)
            yield pd.DataFrame({"entry": list(seen), "n": list(seen.values())})

    def summed(label: int, counter) -> DataFrame:
        return rows.where(f"label = {label}").select("text").mapInPandas(counter, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    sizes = dict(rows.groupBy("label").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return Lexicon(exceptions=sorted({f" {folded(x).strip()} " for x in exceptions}))
    top = summed(1, of_toxic).where(f"n >= {LEAST_SUPPORT}").orderBy(F.desc("n"), "entry").limit(CANDIDATES).toPandas().set_index("entry").n
    held = labelled.sparkSession.sparkContext.broadcast(frozenset(top.index))
    clean = summed(0, of_clean).toPandas().set_index("entry").n.reindex(top.index, fill_value=0)
    odds = np.log((top + 0.5) / (n_toxic + 1) * (n_clean + 1) / (clean + 0.5))
    odds_of = odds[odds > LEAST_ODDS].to_dict()

    def caught(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch.label, "found": [sorted(e for e in entries(t) if e in odds_of) for t in batch.text]})

    toxic_docs = rows.where("label = 1").mapInPandas(caught, "label int, found array<string>").toPandas()
    having: dict[str, set[int]] = {}
    for k, found in enumerate(toxic_docs.found):
        for e in found:
            having.setdefault(e, set()).add(k)
    # An entry counts again in documents caught once: they may hold others' words only by chance.
    # Of entries that catch nearly the same, the longest is the safest.
    heaviness = np.ones(len(toxic_docs))
    worth = {e: odds_of[e] * (1 + 0.01 * min(len(e), 8)) for e in having}
    queue = [(-len(d) * worth[e], e) for e, d in having.items()]
    heapq.heapify(queue)
    members = {e: np.fromiter(d, np.int64) for e, d in having.items()}
    weights: dict[str, float] = {}
    while queue:
        believed, entry = heapq.heappop(queue)
        support = heaviness[members[entry]].sum()
        if support < LEAST_GAIN:
            continue
        if support * worth[entry] < -believed - 1e-9:
            heapq.heappush(queue, (-support * worth[entry], entry))
            continue
        weights[entry] = round(float(odds_of[entry]), 4)
        heaviness[members[entry]] *= 0.5
    lexicon = Lexicon(weights, sorted({f" {folded(x).strip()} " for x in exceptions}))
    lexicon.exceptions = sorted({*lexicon.exceptions, *_learned_exceptions(rows, lexicon)})
    lexicon = _calibrated(rows, lexicon)
    scratch.drop(rows)
    return lexicon


def _learned_exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Phrases of a matched word and a neighbour, in folded rows, that three clean documents or more and no toxic one hold."""
    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.matcher()
        for batch in batches:
            out = set()
            for k, (text, label) in enumerate(zip(batch.text, batch.label, strict=True)):
                for end, (size, _) in machine.iter(text) if len(machine) else ():
                    a, b = end - size + 1, text.find(" ", max(end, 1))
                    b = len(text) - 1 if b < 0 else b
                    before, after = text.rfind(" ", 0, a) if a else -1, text.find(" ", b + 1)
                    out.update((k, label, text[p : q + 1]) for p, q in ((before, b), (a, after)) if p >= 0 and q > 0)
            yield pd.DataFrame([(p, y) for _, y, p in sorted(out)], columns=["phrase", "label"])

    got = rows.mapInPandas(around, "phrase string, label int").groupBy("phrase").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    return [r.phrase for r in got.where(f"toxic = 0 and n >= {LEAST_SUPPORT}").orderBy(F.desc("n"), "phrase").limit(EXCEPTIONS).collect()]


def _calibrated(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Bias and slope by Newton steps on the sums of the folded sample, both classes weighing the same."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.matcher()
        for batch in batches:
            yield pd.DataFrame({"x": [lexicon.total(machine, t, s) for t, s in zip(batch.text, batch.second, strict=True)], "y": batch.label})

    got = rows.mapInPandas(sums, "x double, y int").toPandas()
    x, y = got.x.to_numpy(), got.y.to_numpy(float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    inputs, beta = np.stack([np.ones_like(x), x]), np.array([-1.0, 1.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(beta @ inputs, -35, 35)))
        slope = inputs @ (weight * (y - p)) - 0.1 * beta
        bend = (inputs * (weight * p * (1 - p))) @ inputs.T + 0.1 * np.eye(2)
        beta = beta + np.linalg.solve(bend, slope)
    lexicon.bias, lexicon.slope = float(beta[0]), float(max(beta[1], 0.0))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, hits) of every row; null, empty and wordless texts have no hit and score by the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def score(batches):
        lex = held.value
        machine = lex.matcher()
        for batch in batches:
            sums = np.array([lex.total(machine, *readings(t.as_py())) for t in batch.column(1)], float)
            chance = [lex.chance(x) for x in sums]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance, pa.float64()), pa.array(sums, pa.float64())], ["doc_id", "score", "weighted_hits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        score, "doc_id long, score double, weighted_hits double")
