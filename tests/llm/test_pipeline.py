"""The pipeline stages, each against a plain version of its decision."""

import random

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as cp
from stintline.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS)


def test_everything_is_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert [n for n, _ in cp.STAGES][-1] == "packing" and len(cp.STAGES) == 5


def test_near_duplicates_keep_one_of_each_class(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(3, base), (1, base + " more"), (2, "something else entirely"), (4, None), (5, ""), (None, base), (6, base.upper()), (2, "something else entirely"), (7, "a b"), (8, "a b")]
    got = cp.near_duplicate_stage(spark, frame(spark, rows).withColumn("component_id", F.lit(1)), "")
    assert got.columns == list(cp.COLUMNS)
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([1, 2, 4, 5, None, 7], key=repr)


def test_decontamination_and_secrets(spark, tmp_path):
    item = " ".join(f"q{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = " ".join(f"c{k}" for k in range(400))
    docs = frame(spark, [(1, "see " + item), (2, clean), (3, None), (4, clean + " " + " ".join(item.split()[:13])), (5, clean[:100] + " " + item)])
    assert {r.doc_id for r in cp.decontamination_stage(spark, docs, str(tmp_path)).collect()} == {2, 3, 4}
    draw = random.Random(1)
    hexes = ["".join(draw.choices("0123456789abcdef", k=40)) for _ in range(60)]
    texts = [(k, f'text token = "{h}" end' if k % 2 else f"text commit {h} end") for k, h in enumerate(hexes)] + [(99, None), (100, "")]
    got = {r.doc_id: r for r in cp.secret_stage(spark, frame(spark, texts), "").collect()}
    assert len(got) == 62 and got[1].text == 'text token = "[SECRET]" end' and got[1].n_chars == 27
    assert got[2].text == texts[2][1] and got[99].text is None and got[100].text == ""


def test_quality_stage_and_run(spark, tmp_path):
    draw = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in "lmnrst"]
    rows = [(k, " ".join(draw.choices(words, k=50)) + "." if k % 3 else " | ".join(draw.choices(words, k=50))) for k in range(240)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[1][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in cp.quality_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert len(kept ^ {k for k in range(240) if k % 3}) <= 4
    out = cp.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) == kept - {1}
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()


def test_rows_without_an_id_are_judged_themselves(spark, tmp_path):
    item = " ".join(f"q{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [(None, "see " + item), (None, "a clean text"), (None, None), (5, "another clean text"), (5, item)])
    got = cp.decontamination_stage(spark, docs, str(tmp_path))
    assert got.columns == list(cp.COLUMNS) and got.schema == docs.schema
    assert sorted((tuple(r)[:2] for r in got.collect()), key=repr) == sorted([(None, "a clean text"), (None, None), (5, "another clean text")], key=repr)
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, base), (None, base + " more"), (None, base), (None, "something else"), (None, "something else"), (3, "a b")]
    got = cp.near_duplicate_stage(spark, frame(spark, rows), "").collect()
    assert len(got) == 3 and sum((r.text or "").startswith("w0") for r in got) == 1 and {r.doc_id for r in got} == {None, 3}
