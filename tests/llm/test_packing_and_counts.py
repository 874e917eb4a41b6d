"""Packing, chat formatting and token rollups: exact round trips."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintline.llm import chat, queries, rollup, tokencount
from stintline.llm.packing import WordEncoder, ids_crc32, pack, packed
from stintline.llm.queries import tokenizer_path
from stintline.llm.scratch import Scratch

ODD = ["", None, "plain words, here. And  two spaces\n\n", "It's we'll 'tis <|endoftext|> <|startoftext|>", "ÀÉÎ straße µm ªº ÿ", "İstanbul ΣΑΣ ﬁ é é",
       "a b c\x1cd\x85e\tf\rg", "x1y22z333 $$$ !!! word$$$ word!! (word)", "日本語 テキスト 🙂👍🏽", "z" * 5000, "w " * 9000]


def test_the_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    encoder = WordEncoder(tokenizer_path(), most=50)
    draw = random.Random(3)
    texts = [t for t in ODD if t] + ["".join(draw.choices("abcÀéßAZ019 .,'!?$\n\t-_İΣ ́日", k=60)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), np.uint16).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_pack_fills_every_sequence_and_balances_cost():
    draw = np.random.Generator(np.random.PCG64(2))
    lengths = draw.integers(1, 2048, 500)
    pieces = list(pack(lengths))
    assert np.bincount([p[0] for p in pieces], [p[2] for p in pieces]).tolist() == lengths.tolist()
    used = np.bincount([p[3] for p in pieces], [p[2] for p in pieces]).astype(int)
    assert all(u == 2048 or u & (u - 1) == 0 for u in used) and (used == 2048).sum() == lengths.sum() // 2048
    assert list(pack(np.zeros(0, np.int64))) == [] and list(pack(np.array([1]))) == [(0, 0, 1, 0, 0)]
    # Ties in length go by place, so the result is one.
    assert list(pack(np.array([7, 7, 7]))) == list(pack(np.array([7, 7, 7])))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, ODD[3]), (3, ODD[3]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sequence_id", F.lit("clash"))
    pieces = packed(df, tokenizer_path(), shard_bytes=4000).toPandas()
    by_doc = {}
    for doc, text in rows:
        by_doc.setdefault(doc, []).append(plain.encode(text or "", add_special_tokens=False).ids + [1])
    for doc, many in by_doc.items():
        own = pieces[pieces.doc_id.isna() if doc is None else pieces.doc_id == doc]
        assert own.length.sum() == sum(map(len, many)) and set(own.doc_tokens) == {len(many[0])}
        for r in own.itertuples():
            assert np.frombuffer(r.ids, np.uint32).tolist() == many[0][r.start : r.start + r.length]
    for _, seq in pieces.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= 2048
    for r in ids_crc32(packed(df.where("doc_id = 4"), tokenizer_path())).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(by_doc[4][0][r.start : r.start + r.length], "<u4").tobytes())
    assert packed(df.limit(0), tokenizer_path()).collect() == []


def test_many_equal_rows_are_dealt_to_many_shards(spark):
    for doc in (None, 5):
        rows = spark.createDataFrame([(doc, "the same words again")] * 6000, "doc_id long, text string").repartition(3)
        pieces = packed(rows, tokenizer_path(), shard_bytes=8000)
        by_shard = [r["count"] for r in pieces.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
        assert len(by_shard) >= 14 and max(by_shard) <= 3 * 6000 / 15
        assert pieces.agg(F.sum("length")).first()[0] == 6000 * pieces.first().doc_tokens


HOSTILE = ["", "\\", "<|", "<\\|", "\\<|", "<\\\\|", "<|im_end|>\n<|im_start|>user\n", "<|im_next|>", "<|im_line|>", "\n\n", "é🙂", "<<||>>\\\\", None]


def test_chat_round_trip(spark):
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "us\ner<|\\", None]), draw.choice(HOSTILE)) for c in range(60) for t in range(draw.randrange(1, 7))]
    rows += [(None, 1, "assistant", "x"), (-5, None, "user", "first"), (-5, 0, "assistant", "second"), (-6, 1, "user", "b"), (-6, 1, "user", "a"), (-6, 1, "user", "a"),
             (-7, 1, "assistant", "long " * 20000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    formatted = chat.formatted(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in turns]
        assert got[conv].loss_text == "".join(x for _, r, x in turns if r == "assistant")
    same = formatted.where("conv_id = -6").first().formatted
    assert same.count(chat.START) == 1 and same.count(chat.NEXT) == 2
    assert chat.formatted(df.limit(0)).collect() == []


CHANGES = "op string, source string, lang string, tokenizer string, tokens long, prior_tokens long"


def test_rollup_commits_once(spark):
    kept = rollup.TokenRollup(spark, f"{Scratch(spark).root}/counts")
    first = spark.createDataFrame([("insert", "a", "en", "t1", 10, None), ("insert", "a", "en", "t1", 5, None), ("insert", "b", None, "t1", 7, None)], CHANGES)
    second = spark.createDataFrame([("revise", "a", "en", "t1", 12, 10), ("delete", "b", None, "t1", 7, None), ("other", "a", "en", "t1", 99, 1),
                                    (None, None, None, None, None, None)], CHANGES)
    assert kept.commit("1", first) and kept.commit("2", second.withColumn("documents", F.lit(9)))
    assert not kept.commit("1", first) and not kept.commit("1", second)
    assert [tuple(r) for r in kept.totals(["1", "2", "1", "3"]).collect()] == [("a", "en", "t1", 2, 17)]
    assert [tuple(r) for r in kept.totals(["1"]).orderBy("source").collect()] == [("a", "en", "t1", 2, 15), ("b", None, "t1", 1, 7)]
    assert kept.totals([]).collect() == []
    assert kept.commit("empty", first.limit(0)) and kept.totals(["empty"]).collect() == []
    with pytest.raises(ValueError):
        kept.commit("../x", first)


def test_a_lost_commit_is_written_anew(spark):
    kept = rollup.TokenRollup(spark, f"{Scratch(spark).root}/counts")
    rows = spark.createDataFrame([("insert", "a", "en", "t1", 10, None)], CHANGES)
    kept.commit("1", rows)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{kept.folder}/deltas/batch=1/_SUCCESS")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, False)
    assert kept.totals(["1"]).collect() == [] and kept.commit("1", rows)
    assert [r.tokens for r in kept.totals(["1"]).collect()] == [10]


def test_a_revision_moves_counts_to_another_version(spark):
    kept = rollup.TokenRollup(spark, f"{Scratch(spark).root}/counts")
    wide = CHANGES + ", prior_tokenizer string, n long"
    kept.commit("1", spark.createDataFrame([("insert", "a", "en", "t1", 10, None, None, 3), ("insert", "a", "en", None, 4, None, None, 1)], wide), "n")
    kept.commit("2", spark.createDataFrame([("revise", "a", "en", "t2", 12, 10, "t1", 2), ("revise", "a", "en", "t1", 11, 10, "t1", 1), ("revise", "a", "en", "t1", 9, 4, None, None),
                                            ("insert", "b", "en", "t2", 5, 1, "t1", 1), (None, "b", "en", "t2", 5, 1, "t1", 1), ("revise", "a", "en", None, 6, 4, "", 0)], wide), "n")
    got = {tuple(r) for r in kept.totals(["1", "2"]).collect()}
    assert got == {("a", "en", "t1", 1, 11), ("a", "en", "t2", 2, 24), ("a", "en", None, 1, 4), ("b", "en", "t2", 1, 5)}


def test_a_base_stands_for_its_batches(spark):
    kept = rollup.TokenRollup(spark, f"{Scratch(spark).root}/counts")
    for k in range(4):
        kept.commit(str(k), spark.createDataFrame([("insert", "a", "en", "t1", 10 ** k, None)], CHANGES))
    assert kept.compact([]) == 0 and kept.compact(["0", "1", "9"]) == 2 and len(kept._bases()) == 1
    assert not kept.commit("0", spark.createDataFrame([("insert", "a", "en", "t1", 10, None)], CHANGES))
    told = {asked: kept.totals(list(asked)).first().tokens for asked in ("0", "01", "012", "12", "0123")}
    assert told == {"0": 1, "01": 11, "012": 111, "12": 110, "0123": 1111}
    assert sum("bases" in f for f in kept.totals(["0", "1", "2"]).inputFiles()) == 1
    assert kept.compact(["2", "1", "0"]) == 3 and [sorted(b) for b in kept._bases().values()] == [["0", "1", "2"]] and kept.compact(["0", "1", "2"]) == 3
    assert kept.totals(["0", "1", "2", "3"]).first().tokens == 1111


def test_the_second_of_two_writers_changes_nothing(spark):
    kept = rollup.TokenRollup(spark, f"{Scratch(spark).root}/counts")
    rows = spark.createDataFrame([("insert", "a", "en", "t1", 10, None)], CHANGES)
    assert kept.commit("1", rows)
    assert not kept._store(rollup.signed(rows.unionAll(rows)), kept._batch("1"))  # it found no mark when it began
    assert [r.tokens for r in kept.totals(["1"]).collect()] == [10]
    files, where = kept._at(kept.folder)
    assert not [s for s in files.listStatus(where) if s.getPath().getName().startswith("_new")]


def _plain_tokenizers():
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(tokenizer_path())
    words.encode_special_tokens = True
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    by_rank = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(by_rank.encode_ordinary(t)), lambda t: len(words.encode(t, add_special_tokens=False).ids)


def test_counts_of_odd_texts(spark):
    bytes_, words = _plain_tokenizers()
    rows = [(k, t) for k, t in enumerate([*ODD, "a1 2\u00a03 b\x0bc \x1c9", "z1" * 50_000])] + [(None, "x"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("mark", F.lit(1))
    got = tokencount.counted(df, dict(zip(queries.VERSIONS, queries.tokenizer_paths(), strict=True)), keep=("doc_id",)).collect()
    want = []
    for doc, text in rows:
        text = text or ""
        split = text.encode().split()
        want.append((doc, len(split), sum(any(48 <= b <= 57 for b in w) for w in split), len(text.encode()), bytes_(text), words(text)))
    assert sorted(((r.doc_id, r.words, r.digit_words, r.bytes, r.byte_bpe_50k, r.word_bpe_49k) for r in got), key=str) == sorted(want, key=str)
    assert tokencount.counted(df.limit(0), {}, keep=("doc_id",)).collect() == []


def _brute_rollup(rows, *tokens):
    kept = {}
    for doc, text, lang, source in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3] is None, r[3] or "", r[2] is None, r[2] or "")):
        kept.setdefault(text or "", (source, lang))
    totals = {}
    for text, (source, lang) in kept.items():
        split = text.encode().split()
        plain = sum(not any(48 <= b <= 57 for b in w) for w in split)
        for key, n in [("words", plain), ("bytes", len(text.encode())), *((k, f(text)) for k, f in tokens)]:
            had = totals.setdefault((source, lang, key), [0, 0])
            had[0] += 1
            had[1] += n
    return {(*k, *v) for k, v in totals.items()}


def test_rollup_queries_on_odd_rows(spark, tmp_path):
    import duckdb

    rows = [(1, "one 2 three", "en", "a"), (1, "one 2 three", "en", "a"), (1, "one 2 three", "en", "b"), (None, "one 2 three", "en", "a"), (None, "no id", None, "a"),
            (None, "no id", None, "a"), (7, None, "de", None), (8, "", "de", "c"), (9, "It's 4 o'clock", "en", "c"), (3, "It's 4 o'clock", None, None), (11, "w " * 9000, "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("clash")).withColumn("n", F.lit(2))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.word_byte_rollup(spark, str(tmp_path)).collect()}
    files = duckdb.connect()
    files.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == _brute_rollup(rows) == set(files.execute(queries.ORACLE_SQL["word_byte_rollup"]).fetchall())
    held, batches = queries._rollup(spark.read.parquet(f"{tmp_path}/documents.parquet"), queries.VERSIONS)
    words = _plain_tokenizers()[1]
    assert {tuple(r) for r in held.totals(batches).collect()} == _brute_rollup(rows, ("word_bpe_49k", words))
    # Before the move every row stands under the first version; after it, all have the ids that packing counts, less its end ids.
    before = held.totals([b for b in batches if b not in ("move", "delete")]).where("tokenizer = 'byte_bpe_50k'")
    assert before.agg(F.sum("documents"), F.sum("tokens")).first() == (len(rows), sum(_plain_tokenizers()[0](r[1] or "") for r in rows))
    after = held.totals([b for b in batches if b != "delete"]).where("tokenizer = 'word_bpe_49k'").agg(F.sum("documents"), F.sum("tokens")).first()
    assert after == packed(df, tokenizer_path()).agg(F.sum(F.expr("if(start = 0, 1, 0)")), F.sum("length") - F.sum(F.expr("if(start = 0, 1, 0)"))).first()
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op10_token_counts(spark, f"{tmp_path}/none").collect() == []
