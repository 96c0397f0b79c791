import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tabwright.llm import conversation_trie as ct
from tabwright.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos int, part string, words int"
EMPTY = hashlib.sha256().hexdigest()


def sequences(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv_id, found in turns.items():
        key = lambda t: (t[0], hashlib.sha256(f"{len(t[1])}:{t[1]}{len(t[2])}:{t[2]}".encode()).digest()[:16])
        out[conv_id] = [t[1:] for t in sorted(found, key=key)]
    return out


def plain_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_nodes(of):
    members = defaultdict(list)
    for c, turns in of.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, set()
    spaces = str.maketrans({c: " " for c in "\t\n\v\f\r"})
    for node in sorted(members, key=len, reverse=True):
        words = sum(1 for w in node[-1][1].translate(spaces).split(" ") if w) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * words
        ends = ",".join(str(c) for c in sorted(members[node]) if len(of[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.add((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], digest))
    return out


def nodes(spark, rows, rebuilt=False):
    turns = ct.turn_rows(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA))
    if rebuilt:
        found = ct.trie_nodes(*ct.rebuilt(turns))
    else:
        found = ct.trie_nodes(turns, ct.members_of(turns))
    assert found.columns == list(ct.COLUMNS)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in range(600):
        conv_id = c * 7 - 300
        rows += [(conv_id, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "", "a  b\x0bc\xa0d"])) for t in range(rng.choice([1, 2, 3, 5, 9]))]
    assert nodes(spark, rows) == plain_nodes(sequences(rows))
    assert nodes(spark, rows, True) == plain_nodes(plain_rebuilt(sequences(rows)))


def test_copies_and_a_long_conversation(spark):
    same = [("user", "hello there"), ("assistant", "hi"), ("user", "more words here")]
    rows = [(c, t, *turn) for c in range(3000) for t, turn in enumerate(same[: 1 + c % 3])]
    rows += [(c, t, "user", f"turn {t}") for c in (5000, 5001) for t in range(300 + c % 2)] + [(6000, t, "user", f"only {t}") for t in range(4000)]
    assert nodes(spark, rows) == plain_nodes(sequences(rows))


def test_a_block_for_each_row(spark):
    """Every prefix goes on beyond its block."""
    rows = [(c, t, "user", f"{(c >> t) & 1} w") for c in range(64) for t in range(c % 7)] + [(c, 9, "user", "z") for c in range(64)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert nodes(spark, rows) == plain_nodes(sequences(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_interval_ends_by_range_minima():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64, 65):
        shared = rng.integers(0, 4, n)
        shared[0] = -1
        levels = ct.sparse_table(shared)
        at, depth = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
        left, right = ct.left_end(levels, at, depth), ct.right_end(levels, at, depth)
        for i, d, a, b in zip(at, depth, left, right):
            assert a == max(k for k in range(i + 1) if k == 0 or (k <= i and shared[k] < d)) if i else a == 0
            assert b == next((k - 1 for k in range(i + 1, n) if shared[k] < d), n - 1)


def test_defined_cases(spark):
    rows = [
        (None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", "q"), (1, 0, "user", "q"), (2, 5, None, ""), (2, 6, "user", "q"),
        (20, 0, "user", "long word " * 200_000), (25, 0, "user", "x"), (25, 1, "a", "y"), (25, 2, "a", "z"), (25, 3, "a", "w"), (-7, 1, "user", "n"),
    ]
    assert nodes(spark, rows) == plain_nodes(sequences(rows))
    assert nodes(spark, rows, True) == plain_nodes(plain_rebuilt(sequences(rows)))
    assert nodes(spark, []) == set() and nodes(spark, [(None, 1, "a", "b")]) == set()
    assert nodes(spark, [(4, 0, "user", "x")], True) == plain_nodes(plain_rebuilt({4: [("user", "x")]}))


def test_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    want = plain_nodes(plain_rebuilt(sequences([tuple(r) for r in table.collect()])))
    found = QUERIES["op13_prefix_trie"](spark, "/root/testdata/sf0.01")
    assert {tuple(r) for r in found.select(*ct.COLUMNS).collect()} == want
    assert found.filter(F.col("depth") == 0).count() == 1
