"""The n-gram Jaccard join and benchmark decontamination against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintline.llm import jaccard, wordhash
from stintline.llm.decontam import contamination, postings
from stintline.llm.jaccard import _overlaps, jaccard_classes, light_boundary
from stintline.llm.queries import contamination_digest, op5_decontamination


def brute_classes(rows, n_words, percent):
    sets = {}
    for doc, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        grams = {tuple(w[k : k + n_words]) for k in range(len(w) - n_words + 1)} if len(w) >= n_words else ({tuple(w)} if w else set())
        sets.setdefault(doc, []).append(grams)
    up = {d: d for d in sets if d is not None}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in itertools.combinations(up, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return sorted(((d, len(s), top(d) if d is not None else None) for d, many in sets.items() for s in many), key=repr)


def corpus(seed, n=60, words=40):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)]
    rows = []
    for doc in range(n):
        if rows and draw.random() < 0.6:
            w = (draw.choice(rows)[1] or "").split()
            for _ in range(draw.choice((0, 0, 1, 1, 2, 3))):
                w.insert(draw.randrange(len(w) + 1), draw.choice(vocabulary))
            rows.append((doc, " ".join(w)))
        else:
            rows.append((doc, " ".join(draw.choices(vocabulary, k=draw.choice((1, 3, 8, 12, words, 3 * words))))))
    return rows


@pytest.mark.parametrize(("seed", "n_words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 85)])
def test_classes_match_brute_force(spark, seed, n_words, percent):
    rows = corpus(seed)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n_words=n_words, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_classes(rows, n_words, percent)


def test_classes_of_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "x"), (1, text, "x"), (2, text.upper(), "y"), (3, None, "z"), (4, "", None), (5, " \t\n", None), (None, text, None), (6, "one", ""),
            (7, "one", ""), (8, "été été", ""), (9, "w " * 3000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("n", F.lit(1))
    got = {r.doc_id: r for r in jaccard_classes(df, n_words=4, percent=85).collect()}
    assert jaccard_classes(df, n_words=4, percent=85).count() == len(rows)
    assert [got[d].component_id for d in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 1, 3, 4, 5, 6, 6, 8, 9]
    assert got[None].component_id is None and got[3].n_shingles == 0 and got[9].n_shingles == 1
    assert jaccard_classes(df.limit(0)).collect() == []


def test_rows_of_one_id_tie_their_classes_together(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    got = jaccard_classes(spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {1}


def test_a_crowded_bitmap_loses_no_link(spark):
    rows = corpus(5)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n_words=4, percent=85, bitmap_bits=8)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_classes(rows, 4, 85)


def test_members_left_over_in_long_lists_meet_in_blocks(spark, monkeypatch):
    """A family of near copies of which most do not link, over several blocks of a list."""
    draw = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for doc in range(160):
        words = [f"x{doc}_{k}" if draw.random() < (doc % 9) / 100 else w for k, w in enumerate(base)]
        rows.append((doc, " ".join(words)))
    want = brute_classes(rows, 4, 85)
    assert len({c for _, _, c in want}) > 20
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", 1)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n_words=4, percent=85)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_bound_of_an_overlap_from_cells():
    draw = np.random.default_rng(3)
    left, right = draw.integers(0, 4, (5, 256)).astype(np.uint8), draw.integers(0, 3, (7, 256)).astype(np.uint8)
    left[2, 9] = right[4, 9] = 255
    most, full = jaccard._cells_in_common(left, right)
    assert (most == np.minimum(left[:, None], right[None]).sum(2, dtype=np.int64)).all()
    assert full.sum() == 1 and full[2, 4]


def test_light_sets_enumerate_what_a_link_needs():
    for percent in (80, 85):
        light = light_boundary(percent, 1.2)
        assert light >= 5
        for a in range(1, light + 1):
            for b in range(a, light + 1):
                if 100 * a >= percent * b:
                    need = -(-percent * (a + b) // (100 + percent))
                    assert need in _overlaps(a, percent, light) and need in _overlaps(b, percent, light)


def brute_contamination(docs, items, width=13):
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())

    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(width, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                for item in windows.get(tuple(w[k : k + size]), ()):
                    hit.update(range(k, k + size))
                    found.add(item)
        out.append((doc, len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination_matches_brute_force(spark):
    draw = random.Random(7)
    vocabulary = [f"v{k}" for k in range(6)] + ["été", "Übung", "A1"]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice((3, 13, 20, 30))))) for k in range(12)] + [(12, None), (13, "..."), (14, "Solo")]
    docs = []
    for doc in range(80):
        w = draw.choices(vocabulary, k=draw.choice((0, 2, 40, 200)))
        if draw.random() < 0.7:
            at = draw.randrange(len(w) + 1)
            w[at:at] = (draw.choice(items)[1] or "").split()[: draw.choice((5, 13, 40))]
        docs.append((doc, draw.choice((" ", ", ", "\n")).join(w)))
    docs += [(80, None), (81, ""), (None, "solo"), (82, "SOLO! solo"), (82, "SOLO! solo")]
    got = contamination_digest(contamination(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")),
                                             spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))))
    assert sorted((tuple(r) for r in got.drop("items_sha256").collect()), key=repr) == brute_contamination(docs, items)


def test_contamination_of_empty_tables_and_near_matches(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma z"), (2, "alpha " + "x " * 50 + "beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "gamma alpha beta")], "item_id long, text string")
    assert [r.n_words for r in contamination(docs, items.limit(0)).orderBy("doc_id").collect()] == [6, 53]
    assert contamination(docs.limit(0), items).collect() == []
    near = {r.doc_id: r.matches for r in contamination(docs, items, near_terms=3, slack=5).collect()}
    assert [m.kind for m in near[1]] == ["near"] and near[2] == []


def test_postings(spark):
    docs = spark.createDataFrame([(1, "b a B c"), (2, None)], "doc_id long, text string")
    assert sorted((r.term, r.positions) for r in postings(docs, ["b", "c", "q"]).collect()) == [("b", [0, 2]), ("c", [3])]


def matches_of(found):
    return sorted(((r.doc_id, r.n_words, [tuple(m) for m in r.matches]) for r in found.collect()), key=repr)


def test_contamination_does_not_depend_on_the_chunks(spark):
    draw = random.Random(12)
    words = [f"v{k}" for k in range(40)]
    items = [(str(k % 20), " ".join(draw.choices(words, k=draw.choice((4, 13, 30, 60))))) for k in range(30)]
    items += [(None, "n1 n2 n3"), (None, "n3 n4 n5 n6"), ("long", " ".join(f"z{k}" for k in range(400)))]
    docs = []
    for doc in range(40):
        w = draw.choices(words, k=30)
        for _ in range(2):
            w += draw.choice(items)[1].split()
        docs.append((draw.choice((None, 7, doc)), " ".join(w)))
    docs += [(None, "see n1 n2 n3 n4 n5 n6"), (99, "a " + items[-1][1])]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for near in (0, 10):
        want = matches_of(contamination(docs, items, near_terms=near))
        assert len(want) == 42 and any(m[0] is None for _, _, found in want for m in found)
        assert (99, 401, ("long", 1, 400, "phrase")) in [(d, n, m) for d, n, found in want for m in found]
        assert matches_of(contamination(docs, items, near_terms=near, most=300)) == want


def brute_near(docs, items, least, slack, width=13):
    """(document row, item, position) by the definition."""
    split = [text.split() for text in docs]
    counts = {}
    for w in split:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    code = {x: int(h) for x in counts for h in wordhash.words(np.frombuffer(x.encode(), np.uint8), wordhash.ALNUM)[2]}
    out = set()
    for item, text in items:
        w = text.split()
        size = min(width, len(w))
        for k in range(len(w) - size + 1):
            terms = sorted(set(w[k : k + size]), key=lambda x: (counts.get(x, 0), code.get(x, 0)))
            for d, words in enumerate(split):
                for p, x in enumerate(words):
                    if x in terms[: max(0, len(terms) - least + 1)] and len(set(words[max(0, p - slack) : p + slack + 1]) & set(terms)) >= least:
                        out.add((d, item, p))
    return out


def test_near_places_match_brute_force_whatever_the_batches(spark):
    draw = random.Random(13)
    common = [f"c{k}" for k in range(12)]
    items = [(str(k), " ".join(draw.choices(common, k=4) + [f"i{k}w{j}" for j in range(12)] + draw.choices(common, k=4))) for k in range(6)]
    docs = []
    for k in range(40):
        w = items[k % 6][1].split()
        for _ in range(k % 5):
            w[draw.randrange(len(w))] = f"other{k}"  # words that stand nowhere else
        docs.append(" ".join(draw.choices(common, k=draw.choice((0, 9))) + w + draw.choices(common, k=5)))
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    want = brute_near(docs, items, 10, 8)
    assert want

    def places():
        got = contamination(rows, benchmark, near_terms=10, slack=8).collect()
        return {(r.doc_id, m.item_id, p) for r in got for m in r.matches if m.kind == "near" for p in range(m.start, m.start + m.length)}

    assert places() == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert places() == want  # a document alone in its run
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_op5_gives_near_places_of_a_copy_with_a_replaced_word(spark, tmp_path):
    w = [f"q{k}" for k in range(13)]
    spark.createDataFrame([(1, " ".join(w))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    copy = " ".join(w[:6] + ["nowhere"] + w[7:])
    spark.createDataFrame([(1, copy), (2, "plain text"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op5_decontamination(spark, str(tmp_path)).collect()}
    assert got[1].near and got[1].n_hit == 0 and not got[1].contaminated and got[2].near == [] and got[None].near == []
