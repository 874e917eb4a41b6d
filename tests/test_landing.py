"""Records of JSON files cut by byte ranges, against the json module."""

import json
import random

import pytest

from stintline.sources.landing import documents, records


def odd_records(n, seed=1):
    draw = random.Random(seed)
    pool = ["plain", "a}b", "{", "}", '"', '\\', '\\"}', "},{", '},{"k": 1', "é🙂}", "[", "]", "\n", "", "tab\t"]
    for k in range(n):
        r = {"k": k, "".join(draw.choices(pool, k=2)): draw.choice(pool), "n": draw.choice((None, 1.5, True, [1, 2], [])), "s": "".join(draw.choices(pool, k=3))}
        if draw.random() < 0.2:
            r["inner"] = {"a": {"b}": "}"}, "c": [{"d": "{"}, {}]}
        yield r


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("shape", [{"separators": (",", ":")}, {"indent": 2}, {"ensure_ascii": False}])
def test_records_of_many_ranges(spark, tmp_path, small_ranges, shape):
    files = {}
    for f in range(2):
        rows = list(odd_records(300, f))
        files[f"{f}.json"] = rows
        (tmp_path / f"{f}.json").write_text(json.dumps(rows, **shape))
    df = records(spark, str(tmp_path))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = {}
    for r in df.orderBy("offset").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.text))
    assert got == files


def test_a_large_file_of_one_line_takes_several_tasks(spark, tmp_path):
    rows = [{"session_key": 1, "driver_number": k % 20, "date": "2024-05-01T13:00:00", "x": k * 1.0, "y": 2.0, "z": 0.0} for k in range(60_000)]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        df = records(spark, str(tmp_path))
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() >= 5
        assert df.count() == 60_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(("text", "want"), [
    ("", []), ("[]", []), (" [ ] \n", []), ('{"a": 1}', [{"a": 1}]), ('[{"a": 1}, {"b": 2', [{"a": 1}]), ('{"a": 1}\n{"a": 2}\n', [{"a": 1}, {"a": 2}]),
    ('[{}, {"a": "}"}]', [{}, {"a": "}"}]), ('[{"a": {"b": {}}}]', [{"a": {"b": {}}}]), ('[{"a": {"b": 1}', [])])
def test_ends_of_files(spark, tmp_path, text, want):
    (tmp_path / "x.json").write_text(text)
    assert [json.loads(r.text) for r in records(spark, str(tmp_path)).orderBy("offset").collect()] == want


def test_whole_documents(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a":\n {"b": 1}}')
    assert json.loads(documents(spark, str(tmp_path)).first().text) == {"a": {"b": 1}}
