"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from stintline.llm.spelling import PositionIndex, near_words, variant_groups, vocabulary


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_vocabulary(rows, least=7, spoiled=31):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % spoiled == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= least and n >= 2}


def plain_groups(words, ratio=10):
    forms, out = {}, {}
    for w, n in words.items():
        others = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        forms[w] = others[0] if others and words[others[0]] >= ratio * n else None
        out[w] = (n, len(others), words[forms[w]] if forms[w] else None)
    rows = []
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, *out[w]))
    return sorted(rows)


def texts(seed, docs=60):
    draw = random.Random(seed)
    parts = ["ab", "Ba", "cé", "én", "ÿo", "tion", "RE", "a", "aa"]
    rows = []
    for doc in range(docs):
        words = ["".join(draw.choices(parts, k=draw.choice((2, 3, 3, 4, 5)))) for _ in range(80)]
        rows.append((doc, draw.choice((" ", "-", ", 1")).join(words) + draw.choice(("", "×÷×÷×÷×", " Ç日本ÀÀÀÀÀÀÀ", "Āabcdefgh"))))
    return rows


def test_the_vocabulary_is_that_of_a_plain_scan(spark):
    rows = texts(1) + [(None, "undisturbed undisturbed"), (900, None), (901, ""), (902, "x" * 300_000 + " " + "longer" * 30 + " "), (903, "x" * 300_000 + " " + "longer" * 30), (904, "twice twice"),
                       (905, "Straßenfest straßenfest STRAßENFEST"), (905, "Straßenfest")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    for spoiled in (31, 2):
        assert {r.word: r.n for r in vocabulary(df, spoiled=spoiled).collect()} == plain_vocabulary(rows, spoiled=spoiled)
    assert vocabulary(df.limit(0)).collect() == []


def test_the_index_finds_what_is_one_error_away():
    draw = random.Random(4)
    words = sorted({"".join(draw.choices("abé", k=draw.randrange(1, 8))) for _ in range(400)})
    index = PositionIndex(words)
    for w in [*words, "", "a", "aaaaaaaaa"]:
        found = index.near(w)
        assert {v for k, v in enumerate(words) if found >> k & 1} == {v for v in words if near(w, v)}


def words_of(seed, n=700):
    draw = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(draw.choices("abcé", k=draw.choice((7, 7, 8, 8, 9, 12))))
        out[w] = draw.choice((2, 2, 3, 40, 500, 7000))
        for _ in range(3):
            k = draw.randrange(len(w) + 1)
            v = draw.choice((w[:k] + "b" + w[k:], w[:k] + w[k + 1 :], w[:k] + "c" + w[k + 1 :]))
            if len(v) >= 7:
                out.setdefault(v, draw.choice((2, 3, 50)))
    return out


def test_groups_match_brute_force_also_in_large_blocks(spark):
    words = words_of(2)
    df = spark.createDataFrame(sorted(words.items()), "word string, n long").withColumn("form", F.lit("clash"))
    want = plain_groups(words)
    assert sum(r[1] is not None for r in want) > 100 and any(r[1] and r[2] != r[1] for r in want)
    assert sorted(map(tuple, variant_groups(df).collect())) == want
    assert sorted(map(tuple, variant_groups(df, part=5, slab=12).collect())) == want
    assert variant_groups(df.limit(0)).collect() == []
    assert near_words(df.limit(1)).collect() == []


def test_equal_beginnings_in_one_hot_block(spark):
    draw = random.Random(9)
    words = {"commonstart" + "".join(draw.choices("xyz", k=5)): draw.choice((2, 30, 900)) for _ in range(200)}
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    assert sorted(map(tuple, variant_groups(df, part=16, slab=40).collect())) == plain_groups(words)


def test_null_words_are_left_out(spark):
    df = spark.createDataFrame([(None, 3), ("abcdefg", None), ("abcdefgh", 50), ("abcdefgi", 5)], "word string, n long")
    assert sorted(map(tuple, variant_groups(df).collect())) == [("abcdefgh", None, "abcdefgh", 50, 1, None), ("abcdefgi", "abcdefgh", "abcdefgh", 5, 1, 50)]
