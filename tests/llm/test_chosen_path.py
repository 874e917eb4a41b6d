"""The chosen-path join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintline.llm import chosenpath
from stintline.llm.chosenpath import near_classes, survival, trees
from test_dedup_and_decontamination import brute_classes, corpus


def classes(df, **how):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_classes(df, **how).collect()), key=repr)


@pytest.mark.parametrize(("seed", "n_words", "percent"), [(1, 2, 80), (2, 5, 80), (3, 2, 85)])
def test_classes_match_brute_force(spark, seed, n_words, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(df, n_words=n_words, percent=percent) == brute_classes(rows, n_words, percent)


def family(seed, n=150, size=90):
    """Near copies of one base, of which many lie close to the threshold on both sides, and some unlike texts."""
    draw = random.Random(seed)
    base = [f"b{k}" for k in range(size)]
    rows = [(doc, " ".join(f"x{doc}_{k}" if draw.random() < (doc % 12) / 150 else w for k, w in enumerate(base))) for doc in range(n)]
    return rows + [(n + k, " ".join(f"y{draw.randrange(4000)}" for _ in range(size))) for k in range(n)]


def test_a_family_in_small_leaves_and_blocks(spark):
    rows = family(7)
    want = brute_classes(rows, 2, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({c for d, _, c in want if d < 150}) > 20
    assert classes(df, n_words=2) == want
    assert classes(df, n_words=2, leaf=8, block=16, levels=3) == want


def test_pairs_stay_in_number_with_the_members(spark, monkeypatch):
    """The rows of pairs a member do not grow with the family."""
    made = []
    confirmed = chosenpath._confirmed

    def seen(pairs, sets, percent):
        made.append(pairs.count())
        return confirmed(pairs, sets, percent)

    monkeypatch.setattr(chosenpath, "_confirmed", seen)
    for n in (100, 200, 400):
        near_classes(spark.createDataFrame(family(5, n), "doc_id long, text string"), n_words=2, leaf=32, block=32)
    assert [m / n for m, n in zip(made, (100, 200, 400), strict=True)] == pytest.approx([made[0] / 100] * 3, rel=1.0)
    assert made[2] < 12 * 400


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "x"), (1, text, "x"), (2, text.upper(), "y"), (3, None, "z"), (4, "", None), (5, " \t\n", None), (None, text, None), (6, "one", ""),
            (7, "one", ""), (8, "été été", ""), (9, "w " * 3000, ""), (10, " ".join(f"long{k}" for k in range(200_000)), ""), (11, " ".join(f"long{k}" for k in range(200_001)), "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("node", F.lit(1)).withColumn("c", F.lit(1))
    got = near_classes(df, n_words=2)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows_of = got.collect()
    by = {r.doc_id: r for r in rows_of}
    assert len(rows_of) == len(rows)
    assert [by[d].component_id for d in range(1, 12)] == [1, 1, 3, 4, 5, 6, 6, 8, 9, 10, 10]
    assert [by[d].kept for d in (1, 2, 3, 7, 11)] == [True, False, True, False, False]
    assert by[None].component_id is None and by[None].kept is None and by[3].n_shingles == 0 and by[9].n_shingles == 1
    assert near_classes(df.limit(0)).collect() == []


def test_rows_of_one_id_tie_their_classes_together(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    for rows in ([(1, a), (2, a), (2, b), (3, b)], [(2, a), (2, b), (3, b + " more"), (4, a + " more")]):
        got = near_classes(spark.createDataFrame(rows, "doc_id long, text string"), n_words=2)
        assert {r.component_id for r in got.collect()} == {min(d for d, _ in rows)}


def test_trees_reach_the_recall():
    assert 0.9 < survival(80) < 0.96 and survival(80, 1) == pytest.approx(0.96)
    assert (1 - survival(80)) ** trees(80, 0.9999) <= 1e-4 < (1 - survival(80)) ** (trees(80, 0.9999) - 1)


def test_overlaps_by_incidence_blocks():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 9000, k).astype(np.uint64)) for k in (0, 5, 3000, 8000, 8000)]
    got = chosenpath._overlaps(sets[1:], sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[1:]]
