"""The trained operators: held-out accuracy on small made texts, recall against brute force, odd rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintline.llm import hamming, langid, quality, secrets, toxicity
from stintline.llm.queries import tokenizer_path

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "12 34 !!"), (None, "words without an id"), (904, "long " * 50000), (905, "twice"), (905, "twice")]


def made(draw, n, words):
    return " ".join(draw.choices(words, k=n))


def scores(got):
    return {r.doc_id: r.score for r in got.collect()}


def test_quality_holds_out(spark):
    draw = random.Random(1)
    words = [made(draw, 3, "abcdefghijk").replace(" ", "") for _ in range(200)]
    rows, labels = [], []
    for k in range(300):
        good = k % 3 > 0
        text = made(draw, 60, words) + "."
        rows.append((k, text if good else draw.choice((text.upper().replace(" ", "!! "), text.replace(" ", " | "), (words[k % 200] + " ") * 60))))
        labels.append((k, int(good)))
    docs = spark.createDataFrame(rows + ODD, "doc_id long, text string").withColumn("label", F.lit("clash"))
    known = spark.createDataFrame(labels[:200] + [(1, 1), (None, 1), (5, None), (7, 3)], "doc_id long, quality int")
    got = quality.classify(docs, known)
    assert got.count() == len(rows) + len(ODD)
    by = scores(got)
    assert np.mean([(by[k] >= 0.5) == bool(y) for k, y in labels[200:]]) >= 0.95
    assert by[900] == by[901] == by[902] and all(0 <= s <= 1 for s in by.values())
    assert set(scores(quality.classify(docs, known.limit(0))).values()) == {0.5}
    assert quality.classify(docs.limit(0), known).collect() == []


def test_sparse_scores_equal_the_definition():
    import pyarrow as pa

    texts = ["Ab ab, 12 ab!", "", "x"]
    weights = np.random.Generator(np.random.PCG64(1)).normal(size=(1 << 10) + 1)
    got = quality._chances(pa.array(texts), weights, 10)
    for (_, bounds, slots) in quality.features(pa.array(texts), 10):
        for k in range(len(texts)):
            own = slots[bounds[k] : bounds[k + 1]]
            total = sum(weights[i] for row in own for i in row) * quality.SCALE / max(1, len(own))
            assert got[k] == pytest.approx(1 / (1 + np.exp(-total - weights[-1])))


def test_language_holds_out(spark):
    draw = random.Random(2)
    langs = {"aa": "ab bab abba baab".split(), "cc": "cde edc dec ced".split(), "éé": "éàü üé àé éüà".split()}
    rows = [(k, made(draw, 30, langs[x]), x) for k in range(90) for x in [sorted(langs)[k % 3]]]
    odd = [(d, t, None) for d, t in ODD]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    names, profiles = langid.prototypes(docs.where("doc_id % 3 < 3 and doc_id < 45"))
    got = {r.doc_id: r for r in langid.predicted(docs, names, profiles).collect()}
    assert all(got[k].lang_pred == x for k, _, x in rows[45:])
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902, 903))
    assert langid.predicted(docs, names, profiles).count() == len(rows) + len(odd)
    assert langid.predicted(docs.limit(0), names, profiles).collect() == []
    none, empty = langid.prototypes(docs.where("lang is null"))
    assert none == [] and {r.lang_pred for r in langid.predicted(docs, none, empty).collect()} == {"und"}


def test_a_prototype_is_the_bundle_of_its_trigrams(spark):
    letters = langid.letter_vectors(64)
    code = langid._letter_codes()
    a, b = int(code[ord("a")]), int(code[ord("b")])
    want = np.zeros(64)
    for x, y, z in ((0, a, b), (a, b, 0)):
        want += np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z]
    names, got = langid.prototypes(spark.createDataFrame([("AB", "l")], "text string, lang string"), dimensions=64)
    assert names == ["l"] and got[0].tolist() == want.tolist()


def test_folding():
    assert toxicity.folded("Thé 1d10t іdiot m0r0n $cum TR4SH") == " the idiot idiot moron scum trash "
    assert toxicity.folded(None) == toxicity.folded("12 %") == "  "


def test_toxicity_holds_out(spark):
    draw = random.Random(3)
    clean = [f"word{c}{d}" for c in "abcdefgh" for d in "xyz"]
    rows, labels = [], []
    for k in range(240):
        text = made(draw, 50, clean).split()
        if k % 4 == 0:
            text[draw.randrange(50)] = draw.choice(("nasty", "NASTY!", "n4sty", "brute", "brutеs"))
            text[draw.randrange(50)] = draw.choice(("nasty", "brute"))
        elif k % 24 == 1:
            text[10:12] = ["brute", "force"]
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame(rows + ODD, "doc_id long, text string").withColumn("label", F.lit("clash"))
    known = spark.createDataFrame(labels[:160], "doc_id long, toxic int")
    lexicon = toxicity.learn(quality.sample_labelled(docs, known, "toxic"))
    assert any("brute force" in x for x in lexicon.exceptions)
    by = scores(toxicity.scored(docs, lexicon))
    assert np.mean([(by[k] >= 0.5) == bool(y) for k, y in labels[160:]]) >= 0.95
    assert by[900] == by[901] == by[902] < 0.5
    assert toxicity.scored(docs, lexicon).count() == len(rows) + len(ODD)
    empty = toxicity.learn(quality.sample_labelled(docs, known.where("toxic = 0"), "toxic"), ("brute force",))
    assert empty.weights == {} and empty.exceptions == [" brute force "] and max(scores(toxicity.scored(docs, empty)).values()) < 0.5
    assert toxicity.scored(docs.limit(0), lexicon).collect() == []


def test_lexicon_matches_a_plain_search():
    lexicon = toxicity.Lexicon({" bad": 2.0, " bad ": 3.0, " worse": 1.0}, [" worse luck "])
    machine = lexicon.matcher()
    assert lexicon.total(machine, toxicity.folded("bad badly worse luck worse")) == pytest.approx((3 + 2 + 1) / np.sqrt(6))


def test_lexicon_totals_equal_a_plain_scan():
    draw = random.Random(11)
    words = ["bad", "badly", "worse", "luck", "ab", "b"]
    for _ in range(60):
        weights = {e: draw.choice([0.5, 1.0, 2.0]) for w in draw.sample(words, 4) for e in draw.sample([f" {w}", f" {w} ", f" {w[:2]}"], 2)}
        spared = list({" " + " ".join(draw.choices(words, k=draw.randrange(1, 4))) + " " for _ in range(3)} - weights.keys())
        lexicon = toxicity.Lexicon(weights, spared)
        text = toxicity.folded(" ".join(draw.choices(words, k=draw.randrange(0, 40))))
        free = [range(k, k + len(x)) for x in spared for k in range(len(text)) if text.startswith(x, k)]
        plain = 0.0
        for k in range(len(text)):
            size = max((len(e) for e in weights if text.startswith(e, k)), default=0)
            if size and not any(r.start <= k and k + size <= r.stop for r in free):
                plain += weights[text[k : k + size]]
        assert lexicon.total(lexicon.matcher(), text) == pytest.approx(plain / np.sqrt(text.count(" ")))


def test_words_that_end_in_digits_or_signs_have_a_second_reading():
    assert toxicity.readings("hell0 a55, a$$ 1d1075 wow! v29 x_5 5 plain") == (" hell a a id wow v x plain ", " hello ass ass idiots wow v x plain ")
    assert toxicity.readings(None) == toxicity.readings("12 %") == ("  ", "") and toxicity.readings("no marks, 12 b4d!")[1] == ""
    lexicon = toxicity.Lexicon({" ass ": 3.0, " idiot": 2.0, " a ": 0.5, " hell ": 1.0}, [" hell of ", " pain in ass "])
    machine = lexicon.matcher()

    def total(text):
        return lexicon.total(machine, *toxicity.readings(text)) * np.sqrt(toxicity.folded(text).count(" "))

    for text, want in (("a55", 3.0), ("A$$ 1d1075", 5.0), ("a", 0.5), ("hell0", 1.0), ("hell of a55", 3.0), ("pain in a55", 0.5), ("idiot5 and idiots", 4.0),
                       ("a-5", 0.5), ("", 0.0)):
        assert total(text) == pytest.approx(want), text
    draw = random.Random(2)
    for _ in range(300):
        text = "".join(draw.choice(["a", "s", "d", "5", "$", "!", "9", " ", "é", "_", "İ", "ª"]) for _ in range(draw.randrange(30)))
        first, second = toxicity.readings(text)
        assert not second or len(first.split()) == len(second.split())


def test_disguise_at_the_end_of_a_word_is_scored(spark):
    rows = [(k, f"some calm words {k % 7} " + ("you ass fool" if k % 2 else "you nice folk"), k % 2) for k in range(200)]
    known = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(known.select("text", F.col("toxic").alias("label")))
    docs = spark.createDataFrame([(1, "calm words a55 here"), (2, "calm words ass here"), (3, "calm words a here"), (4, None)], "doc_id long, text string")
    by = scores(toxicity.scored(docs, lexicon))
    assert by[1] == by[2] >= 0.5 > by[3] and by[4] < 0.5


def test_a_text_of_many_exceptions_takes_linear_time():
    lexicon = toxicity.Lexicon({" bad": 1.0}, [" bad luck "])
    machine, text = lexicon.matcher(), toxicity.folded("bad luck " * 100_000 + "bad")
    start = time.process_time()
    assert lexicon.total(machine, text) == pytest.approx(1 / np.sqrt(text.count(" ")))
    assert time.process_time() - start < 5


def test_neighbours_match_brute_force(spark):
    draw = np.random.Generator(np.random.PCG64(4))
    x = draw.normal(size=(800, 64))
    x[400:420] = x[400] + 1e-3 * draw.normal(size=(20, 64))
    x[500] = x[501]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(801, None), (802, [0.0] * 64), (803, [float("nan")] * 64), (804, [None] * 64), (805, [1.0] * 3), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = hamming.nearest(df, df.where("vec_id % 20 = 0 or vec_id = 805"), 20).toPandas()
    near = x[::20] @ x.T
    near[np.arange(40), np.arange(0, 800, 20)] = -np.inf
    best = np.argsort(-near, 1, kind="stable")[:, :20]
    found = got.groupby("query_id").vec_id.apply(list)
    assert 805 not in found and set(found.index) == set(range(0, 800, 20))
    assert np.mean([len(set(found[20 * k]) & set(best[k])) / 20 for k in range(40)]) >= 0.9
    for r in got.itertuples():
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), rel=1e-12)
    assert all(g["rank"].tolist() == list(range(1, 21)) and g.score.is_monotonic_decreasing for _, g in got.sort_values("rank").groupby("query_id"))
    few = df.where("vec_id < 5")
    assert hamming.nearest(few, few, 20).count() == 20 and hamming.nearest(few.limit(0), few.limit(0)).collect() == []


def test_the_index_finds_every_code_within_the_radius():
    draw = np.random.Generator(np.random.PCG64(6))
    codes = draw.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    codes[:500] = codes[0] ^ (1 << draw.integers(0, 16, (500, 4))).astype(np.uint16)
    index = hamming.MultiIndex(codes)
    for radius in (0, 3, 7, 20, 27):
        for q in (0, 7, 2000):
            plain = np.flatnonzero(np.bitwise_count(codes ^ codes[q]).sum(1) <= radius)
            assert index.within(codes[q], radius).tolist() == plain.tolist()


def test_secrets(spark):
    draw = random.Random(8)
    hexes = ["".join(draw.choices("0123456789abcdef", k=40)) for _ in range(400)]
    rows = []
    for k, h in enumerate(hexes):
        rows.append((k, draw.choice((f'use api_key = "{h}" here', f"secret: {h}", f"commit {h} fixed it", f"sha256 {h}", f"number {k:020d} end", "averyveryverylongword " * 2))))
    odd = [*ODD, (910, 'token = "EXAMPLEEXAMPLE1234567"')]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("value", F.lit("clash"))
    findings = secrets.labelled_findings(docs.where("doc_id < 200"))
    forest = secrets.train(findings, tokenizer_path())
    got = secrets.scanned(docs, forest, tokenizer_path()).where("doc_id >= 200 and doc_id < 400").collect()
    texts = dict(rows)
    assert len(got) >= 180
    assert all(texts[r.doc_id][r.start : r.start + r.length] == r.value for r in got)
    want = [texts[r.doc_id].startswith(("use", "secret")) for r in got]
    assert np.mean([(r.chance >= 0.5) == w for r, w in zip(got, want, strict=True)]) >= 0.95
    masked = {r.doc_id: r.text for r in docs.select("doc_id", secrets.redacted(F.col("text"), forest, spark, tokenizer_path()).alias("text")).collect()}
    assert masked[900] is None and masked[901] == "" and masked[905] == "twice"
    first = next(k for k, t in rows if t.startswith("use"))
    assert masked[first] == 'use api_key = "[SECRET]" here'
    assert secrets.scanned(docs.limit(0), forest).collect() == []
    one_label = secrets.train(findings.where("label = 1"))
    assert one_label.trees == [] and {r.chance for r in secrets.scanned(docs, one_label).collect()} == {0.0}


def values_of(text):
    return [v for _, v, _, _ in secrets.candidates(text)]


def test_what_is_assigned_to_a_secret_name_is_a_candidate():
    assert values_of("API_KEY=abcd1234EFGH5678ijkl") == ["abcd1234EFGH5678ijkl"]
    assert values_of("aws_secret_access_key=wJalrXUtnFEMI/K7MDENG+bPxRfiCY12== x") == ["wJalrXUtnFEMI/K7MDENG+bPxRfiCY12=="]
    assert values_of("see https://h.net/a?token=ab12cd34&page=2") == ["ab12cd34"]
    assert values_of("id=abcd1234EFGH5678ijkl") == ["abcd1234EFGH5678ijkl"]  # also under another name, by its length
    assert values_of('password: hunter2, "db_passwd":"p@ss w0rd!","user":"bob"') == ["hunter2", "p@ss w0rd!"]
    assert values_of("pwd=x9;Server=db") == ["x9"] and values_of("f(secret='a1')") == ["a1"] and values_of("f(secret=a1)") == ["a1"]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkw.dBjftJeZ4CVPmB92K27uhbUJU1p1r"
    assert values_of(f"Authorization: Bearer {jwt}") == [jwt] and values_of(f"got {jwt}, then") == [jwt] and values_of(f"jwt_token={jwt}.") == [jwt]
    assert values_of("the author: Smith") == values_of("if token == other") == values_of("see docs.python.org") == []


def test_assigned_secrets_of_all_forms_are_masked(spark):
    draw = random.Random(9)
    rows = []
    for k in range(400):
        h = "".join(draw.choices("0123456789abcdef", k=40))
        rows.append((k, f'use token = "{h}" here' if k % 2 else draw.choice((f"commit {h} fixed it", f"number {k:020d} end", "averyveryverylongword " * 2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forest = secrets.train(secrets.labelled_findings(docs), tokenizer_path())
    dotted = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkw.dBjftJeZ4CVPmB92K27uhbUJU1p1r"
    want = {"API_KEY=abcd9876EFGH5678ijkl": "API_KEY=[SECRET]", "http://h/?token=x81kd93jf02ksl&a=1": "http://h/?token=[SECRET]&a=1",
            "password = hunter2": "password = [SECRET]", "db_pwd: Summer2024! ok": "db_pwd: [SECRET] ok", "password='q7!x#2'": "password='[SECRET]'", f"auth_token={dotted}": "auth_token=[SECRET]",
            "the password: must be long": "the password: must be long"}
    texts = spark.createDataFrame([(t,) for t in want], "text string")
    got = {r.text: r.masked for r in texts.select("text", secrets.redacted(F.col("text"), forest, spark, tokenizer_path()).alias("masked")).collect()}
    assert got == want
