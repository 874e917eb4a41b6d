"""The burst trie of conversations against brute force."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from stintline.llm.turntrie import EMPTY, conversation_trie, sweep

COLUMNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members = {}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
        for d in range(len(full[c]) + 1):
            members.setdefault(full[c][:d], []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}

    def below(p):
        leaves, saved = int(not children[p]), (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        for q in children[p]:
            more = below(q)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for p, held in members.items():
        done = ",".join(map(str, sorted(c for c in held if full[c] == p)))
        out.append((min(held), len(p), min(members[p[:-1]]) if p else None, len(held), len(children[p]), *below(p), hashlib.sha256(done.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=150):
    draw = random.Random(seed)
    rows = []
    for c in [*range(-3, n), *range(200, 260), 1005]:
        for t in range(draw.choice((1, 2, 4, 7, 9))):
            rows.append((c, draw.choice((t, t, t, None)) if t == 0 else t, draw.choice(("user", "assistant", None)), draw.choice(("a", "b", "é🙂", "", None, "longer text"))))
    return rows


def got(df, **how):
    return sorted(map(tuple, conversation_trie(df, **how).collect()), key=repr)


def test_nodes_match_brute_force_swept_and_burst(spark):
    for seed in (1, 2):
        rows = conversations(seed)
        df = spark.createDataFrame(rows, COLUMNS).withColumn("depth", F.lit("clash")).withColumn("at", F.lit(1))
        want = brute_trie(rows)
        assert got(df) == want
        assert got(df, container=40) == want
    assert got(df, container=1) == want


def test_a_hot_first_turn_and_many_equal_conversations(spark):
    rows = [(c, t, "user", f"t{t}" if t < 3 or c % 3 else f"own {c % 7}") for c in range(400) for t in range(5)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert got(df, container=64) == brute_trie(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (100, 1, "user", "only"), (101, 1, None, None), (101, None, "a", "first"), (101, 1, None, None), (777, 1, "u", "long " * 50_000), (-1, 1, "u", "n")]
    rows += [(300, t, "user", "again") for t in range(3000)]
    df = spark.createDataFrame(rows, COLUMNS)
    want = brute_trie([r for r in rows if r[0] != 300])
    assert got(df.where("conv_id <> 300 or conv_id is null"), container=1) == want
    deep = conversation_trie(df).collect()
    assert max(r.depth for r in deep) == 3000 and [r.parent_conv_id for r in deep if r.depth == 0] == [None]
    assert conversation_trie(df.limit(0)).collect() == []
    alone = conversation_trie(df.where("conv_id = 100")).collect()
    assert {(r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in alone} == {(0, 1, 1, 1, 0), (1, 1, 0, 1, 0)}


def test_a_conversation_without_turns_ends_at_the_root(spark):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "too")]
    only = conversation_trie(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [tuple(r)[:7] for r in only] == [(c, 0, None, 1, 0, 1, 0)] and only[0].ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest() != EMPTY


def test_sweep_of_one_container():
    a, b, c = (bytes([k]) * 16 for k in (1, 2, 3))
    nodes = sweep([(a + c, [3, 5], 4, 2), (a + b, [3, 7], 9, 1), (a, [3], 6, 1)], 1)
    assert nodes == [[4, 1, None, 4, 2, 2, 9 + 5, 6], [9, 2, 0, 1, 0, 1, 0, 9], [4, 2, 0, 2, 0, 1, 5, 4]]
