"""Secret scan: candidates by pattern, false positives removed by a random forest trained on labelled findings.

A finding's features are its length, its character kinds and the transitions between them, how much of it dictionary words
cover, the kind of path it stands in, and the words around it. The forest is Spark's; its trees are read back as arrays of
bounded size, so a scan is one pass over the documents without a join, and a document's findings stay with its row.

Candidates are long runs of key characters, such runs joined by dots, and whatever is assigned to a name of a secret, of any
length and characters. What is assigned is judged whole; runs within it are candidates too where it has spaces or is an address.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm.memory import give_back, lean
from stintline.llm.scratch import Scratch

SAMPLE = 20_000  # labelled findings the forest is trained on, at most
TREES, DEPTH, SEED = 24, 6, 17
LEAST = 16  # characters of a candidate
AROUND = 48  # characters of context on either side
MASK = "[SECRET]"

_candidate = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}(?![A-Za-z0-9+/_=-])")
_dotted = re.compile(r"(?<![A-Za-z0-9+/_.@-])[A-Za-z0-9_-]{2,}(?:\.[A-Za-z0-9_-]{2,})+={0,2}(?![A-Za-z0-9+/_=-])")
_dotted_part = re.compile(r"[A-Za-z0-9_.-]")
_scheme = r"(?:(?:bearer|basic|token)\s+)?"
_assigned = re.compile(rf"([A-Za-z][A-Za-z0-9_.-]*)[\"']?\s*(?:=|:|:=|=>)\s*[\"'`]?{_scheme}$", re.I)
_equals = re.compile(r":=|=>|[=:]")
_named = re.compile(r"[A-Za-z][A-Za-z0-9_.-]*(?=[\"'`]?\s*$)")
_given = re.compile(rf"\s{{0,64}}(?:\"{_scheme}((?:[^\"\\\r\n]|\\.)+)\"|'{_scheme}((?:[^'\\\r\n]|\\.)+)'|`{_scheme}([^`\r\n]+)`|[\"'`]?{_scheme}([^\s\"'`]\S*))", re.I)
_next_name = re.compile(r"[,;&][\"']?[A-Za-z_][\w.-]*[\"']?[=:]")
_no_secret_name = re.compile(r"author(?!i[sz])|tokeni[sz]|secretar", re.I)
_reference = re.compile(r"\$[A-Z_]+$|\$[{(]|\{\{|<[^>]*>$|%[sd(]|\*+$|[A-Za-z_]+(?:\.[A-Za-z_]+)*[(\[]|[a-z_]+(?:\.[a-z_]+)+$|"
                        r"(?:true|false|null|none|nil|undefined|str|string|bytes|int|bool|required|optional|yes|no|on|off)$", re.I)
_word = re.compile(r"[A-Za-z]+")
_secret_word = re.compile(r"token|secret|passw|pwd|api.?key|apikey|auth|credential|private|access.?key|bearer|signing", re.I)
_digest_word = re.compile(r"\b(sha\d*|md5|crc|checksum|digest|commit|revision|hash|etag|integrity|uuid|guid|build)\b", re.I)
_placeholder = re.compile(r"example|sample|dummy|placeholder|changeme|your|xxxx|0000000|1234567|abcdef0123|redacted|test", re.I)
_path_test = re.compile(r"test|spec|fixture|example|sample|docs?[/_.-]|readme|mock", re.I)
_path_code = re.compile(r"\.(env|ya?ml|json|toml|ini|cfg|conf|properties|tf|py|js|ts|go|rb|java|sh|pem|key)$", re.I)
FEATURES = ("length", "letters", "digits", "upper", "hex", "other", "distinct", "entropy", "kind_changes", "digit_letter", "case_changes", "repeats",
            "dictionary", "longest_word", "path_test", "path_code", "assigned", "secret_before", "secret_near", "digest_near", "placeholder", "quoted",
            "after_slash", "words_before")


@functools.cache
def dictionary(path: str | None) -> frozenset[str]:
    """Whole words of four letters or more in a public tokenizer's vocabulary; empty without one."""
    if not path:
        return frozenset()
    with open(path, encoding="utf-8") as f:
        return frozenset(w[:-4] for w in json.load(f)["model"]["vocab"] if w.endswith("</w>") and w[:-4].isalpha() and len(w) >= 8)


def _coverage(text: str, known: frozenset[str]) -> tuple[int, int]:
    """Letters covered by dictionary words taken greedily from the left, longest first, and the longest of them."""
    covered = longest = 0
    for run in _word.findall(text):
        run, at = run.lower(), 0
        while at + 4 <= len(run):
            size = next((n for n in range(min(len(run) - at, 20), 3, -1) if run[at : at + n] in known), 0)
            covered, longest, at = covered + size, max(longest, size), at + (size or 1)
    return covered, longest


def finding_features(value: str, before: str, after: str, path: str, known: frozenset[str]) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    share = {k: kinds.count(k) / n for k in "dulo"}
    _, counts = np.unique(list(value), return_counts=True)
    p = counts / n
    steps = list(zip(kinds, kinds[1:], strict=False))
    covered, longest = _coverage(value, known)
    name = _assigned.search(before)
    near = before[-AROUND:] + " " + after[:AROUND]
    return [
        n, share["l"] + share["u"], share["d"], share["u"], sum(c in "0123456789abcdefABCDEF" for c in value) / n, share["o"], len(counts) / n,
        float(-(p * np.log2(p)).sum()), sum(a != b for a, b in steps) / n, sum({a, b} in ({"d", "l"}, {"d", "u"}) for a, b in steps) / n,
        sum({a, b} == {"u", "l"} for a, b in steps) / n, sum(a == b for a, b in zip(value, value[1:], strict=False)) / n, covered / n, longest,
        float(bool(_path_test.search(path))), float(bool(_path_code.search(path))), float(name is not None),
        float(bool(name and _secret_word.search(name[1]))), float(bool(_secret_word.search(near))), float(bool(_digest_word.search(near))),
        float(bool(_placeholder.search(value))), float(before[-1:] in ("'", '"', "`") and after[:1] == before[-1:]), float(before[-1:] in "/@." if before else 0),
        len(_word.findall(before[-AROUND:])),
    ]


def weak_label(value: str, before: str, after: str) -> int | None:
    """The label that a finding's evidence settles, or none: how labelled findings are made where nobody has labelled any.

    1: assigned to a name of a secret and neither a placeholder nor made of words. 0: a number, a digest by its neighbours, a
    placeholder, a part of an address or path, or letters of one case, where no name of a secret is near; also a reference to
    a variable or a type, and a plain word in a sentence, where one is.
    """
    name = _assigned.search(before)
    random = any(c.isalpha() for c in value) and any(c.isdigit() or c in "!@#$%^&*?~+" for c in value)
    if name and _secret_word.search(name[1]):
        if _reference.match(value) or (value.isalpha() and before[-1:] == " " and re.match(r" +[a-z]", after)):
            return 0
        if random and not _placeholder.search(value):
            return 1
    if _secret_word.search(before[-AROUND:]):
        return 0 if _placeholder.search(value) else None
    if value.isdigit() or value.isalpha() or _placeholder.search(value) or _digest_word.search(before[-AROUND:]) or before[-1:] in ("/", "@"):
        return 0
    return None


def candidates(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(start, value, before, after) of every candidate of a text. Two overlap only where one of them is assigned and has runs in it."""
    spans = set(_assignments(text))
    whole = sorted((a, b) for a, b in spans if not re.search(r"\s|://", text[a:b]))
    runs = [m.span() for m in _candidate.finditer(text)]
    whole = sorted(whole + [x for x in _dotted_tokens(text, runs) if not _within(x, whole)])
    if whole:
        runs = [x for x in runs if not _within(x, whole)]
    for a, b in sorted(spans.union(whole, runs)):
        yield a, text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]


def _within(span: tuple[int, int], spans: list[tuple[int, int]]) -> bool:
    """Whether a span overlaps one of the sorted ones, of which no two overlap."""
    k = bisect.bisect_left(spans, (span[1], 0))
    return k > 0 and spans[k - 1][1] > span[0]


def _dotted_tokens(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens whose parts are joined by dots: one part at least is a run and mixed, and the last is no plain word."""
    past = 0
    for a, b in runs:
        if a < past or (text[b : b + 1] != "." and text[a - 1 : a] != "."):
            continue
        while a > past and _dotted_part.match(text, a - 1):
            a -= 1
        while text[a] in ".":
            a += 1
        m = _dotted.match(text, a)
        if not m:
            continue
        past = m.end()
        parts = m[0].rstrip("=").split(".")
        mixed = any(len(p) >= LEAST and any(c.isdigit() for c in p) and any(c.isalpha() for c in p) for p in parts)
        if mixed and not (len(parts[-1]) < LEAST and parts[-1].isalpha()):
            yield m.span()


def _assignments(text: str) -> Iterator[tuple[int, int]]:
    """Where values stand that are assigned to a name of a secret: quoted ones whole, others up to a space or the next name."""
    past = 0
    for m in _equals.finditer(text):
        at, end = m.span()
        if at < past or text[end : end + 1] in ("=", ":") or text[at - 1 : at] in ("=", "!", "<", ">", ":") or text[end : end + 2] == "//":
            continue
        before = text[max(0, at - 2 * AROUND) : at]
        if not _secret_word.search(before):
            continue
        name = _named.search(before)
        if not name or not _secret_word.search(_no_secret_name.sub("", name[0])):
            continue
        value = _given.match(text, end)
        if not value:
            continue
        kind = value.lastindex
        a, b = value.span(kind)
        if kind == 4:
            cut = _next_name.search(text, a, b)
            b = cut.start() if cut else b
            if before[: name.start()][-1:] in ("?", "&"):
                b = next((k for k in range(a, b) if text[k] in "&#"), b)
            while b > a and (text[b - 1] in ",;.\"'`" or (text[b - 1] in ")]}>" and text.count(text[b - 1], a, b) > text.count("([{<"[")]}>".index(text[b - 1])], a, b))):
                b -= 1
        if b > a:
            yield a, b
            past = b


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, children, chance of label 1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += leaf[at]
        return total / max(1, len(self.trees))


def labelled_findings(docs: DataFrame, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(value, before, after, path, label) of the candidates of all documents whose own evidence settles a label."""
    def find(batches):
        for batch in batches:
            out = []
            for text, path in zip(batch.column(0), batch.column(1), strict=True):
                for _, value, before, after in candidates(text.as_py() or ""):
                    label = weak_label(value, before, after)
                    if label is not None:
                        out.append((value, before, after, path.as_py() or "", label))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.int32())],
                                             ["value", "before", "after", "path", "label"])

    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    return docs.select(F.col(text_col).cast("string").alias("text"), path.alias("path")).mapInArrow(
        lean(find), "value string, before string, after string, path string, label int")


def train(findings: DataFrame, words: str | None = None, most: int = SAMPLE) -> Forest:
    """A forest from labelled findings (value, before, after, path, label): of each label up to half of `most`, by a hash.

    Equal findings count once. With one label only, or none, the forest is empty and every candidate has chance 0. Short values are
    rarer than long ones, so what is assigned is learned once more in three made forms: cut short, with a sign in half of them, with
    a word of its neighbours and a number in its place, and with such a word alone, label 0.
    """
    keyed = findings.where("value is not null and label in (0, 1)").select(
        "value", *(F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after", "path")), F.col("label").cast("double").alias("label")).distinct()
    parts = [keyed.where(f"label = {y}").orderBy(F.xxhash64("value", "before"), "value", "before", "after", "path").limit(most // 2) for y in (0, 1)]

    @F.pandas_udf("array<double>")
    def featured(value: pd.Series, before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
        known = dictionary(words)
        return pd.Series([finding_features(*x, known) for x in zip(value, before, after, path, strict=True)])

    scratch = Scratch(findings.sparkSession)
    mark = F.xxhash64("value", "after")
    cut = F.expr("substring(value, 1, 5 + pmod(xxhash64(value), 11))")
    signed = F.when(mark % 2 == 0, F.concat(F.substring(cut, 1, 3), F.element_at(F.array(*map(F.lit, "!@#$%&*?")), (F.pmod(mark, F.lit(8)) + 1).cast("int")), F.expr("substring(value, 4, 2 + pmod(xxhash64(value), 11))"))).otherwise(cut)
    word = F.regexp_extract(F.concat_ws(" ", "after", "before"), r"\b([A-Za-z]{2,})\b", 1)
    known = scratch.write(parts[0].unionByName(parts[1]))
    assigned = known.where("label = 1").where(F.col("before").rlike(r"[=:>]\s*[\"'`]?$"))
    made = (assigned.withColumn("value", signed).where(r"value rlike '[0-9]' and value rlike '[A-Za-z]'")
            .unionByName(assigned.withColumn("value", F.concat(word, F.when(mark % 3 == 0, F.lit("!")).otherwise(F.lit("")), F.pmod(mark, F.lit(997)).cast("string"))).where(word != ""))
            .unionByName(assigned.withColumn("value", word).where("value <> ''").withColumn("label", F.lit(0.0))))
    if known.select("label").distinct().count() < 2:
        scratch.drop(known)
        return Forest([])
    rows = scratch.write(known.unionByName(made).repartition(8).select("label", featured("value", "before", "after", "path").alias("x")))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="v").fit(rows.select("label", array_to_vector("x").alias("v")))
    path = f"{scratch.root}/forest"
    model.write().overwrite().save(path)
    nodes = findings.sparkSession.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()
    trees = []
    for _, tree in nodes.groupby("treeID"):
        tree = tree.sort_values("id")
        stats = np.stack(tree.impurityStats)
        split = tree.split
        trees.append((np.array([s["featureIndex"] for s in split]), np.array([(s["leftCategoriesOrThreshold"] or [0.0])[0] if s["featureIndex"] >= 0 else 0.0 for s in split]),
                      tree.leftChild.to_numpy(), tree.rightChild.to_numpy(), stats[:, 1] / stats.sum(1)))
    scratch.drop(known, rows)
    return Forest(trees)


def _judged(text: str, path: str, forest: Forest, known: frozenset[str]) -> list[tuple[int, str, float]]:
    found = list(candidates(text))
    if not found or not forest.trees:
        return [(s, v, 0.0) for s, v, _, _ in found]
    x = np.array([finding_features(v, b, a, path, known) for _, v, b, a in found])
    return [(s, v, float(c)) for (s, v, _, _), c in zip(found, forest.chance(x), strict=True)]


def scanned(docs: DataFrame, forest: Forest, words: str | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, start, length, value, chance) of every candidate, start from 0 in characters. Null and empty texts have none."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def scan(batches):
        known = dictionary(words)
        for batch in batches:
            out = [(i.as_py(), s, len(v), v, c) for i, t, p in zip(*batch.columns, strict=True)
                   for s, v, c in _judged(t.as_py() or "", p.as_py() or "", held.value, known)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "value", "chance"])

    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), path.alias("path")).mapInArrow(
        lean(scan), "doc_id long, start long, length long, value string, chance double")


def redacted(text: Column, forest: Forest, spark: SparkSession, words: str | None = None, least: float = 0.5, mask: str = MASK) -> Column:
    """The text with the mask in place of every candidate of chance `least` or more; null stays null."""
    held = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        known = dictionary(words)
        out = []
        for text in texts:
            found = [x for x in _judged(text, "", held.value, known) if x[2] >= least] if text else []
            spans: list[list[int]] = []
            for s, v, _ in found:
                if spans and s < spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s + len(v))
                else:
                    spans.append([s, s + len(v)])
            for a, b in reversed(spans):
                text = text[:a] + mask + text[b:]
            out.append(text)
        give_back()
        return pd.Series(out, dtype=object)

    return redact(text)
