import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabwright.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, w double, key int, place string, epochs int, target string"


def plain_targets(sizes):
    """Weights 1, 2, 3 in order; what is above three times a size goes to the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if rest * weight[s] / total > 3 * sizes[s]}
        if not above:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in above:
            target[s] = 3 * sizes[s]
        rest -= sum(target[s] for s in above)
        open_ -= above


def mixed(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 0, "x", 1, "y") for r in rows], SCHEMA)
    return mixing.mix_sources(frame, mixing.word_count("text"), F.col("w"), **options).collect()


def test_targets_and_budgets(spark):
    rows = [(i, "w " * (i % 97 + 1), "abcdefg"[min(6, int(math.log2(i % 64 + 1)))], 1.0) for i in range(3000)] + [(9000, "only one here", None, 1.0)]
    found = mixed(spark, rows)
    sizes = Counter()
    for r in found:
        sizes[r.source] += r.size
    targets, taken, cut = plain_targets(sizes), Counter(), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-12)
        assert r.epochs * r.size <= r.taken <= min(3, r.epochs + 1) * r.size
        taken[r.source] += r.taken
        cut[r.source] += 0 < r.taken - r.epochs * r.size < r.size
    assert all(targets[s] - 1 < taken[s] <= targets[s] for s in sizes) and max(cut.values()) <= 1
    assert any(t == 3 * sizes[s] for s, t in targets.items())


def test_documents_are_taken_in_order_of_their_keys(spark):
    """The whole order by the keys, with sums before, against the narrowing."""
    rows = [(i // 2, "w " * (i % 13), "ab"[i % 3 == 0], (i % 5) / 4) for i in range(4000)]
    frame = spark.createDataFrame([(*r, 0, "x", 1, "y") for r in rows], SCHEMA)
    keys = frame.select("doc_id", "source", mixing.word_count("text").alias("size"), mixing.order_key("doc_id", F.col("w"), "mix").alias("key")).collect()
    want = Counter()
    found = mixed(spark, rows)
    state = {r.source: (r.source_size, math.floor(r.target)) for r in found}
    for source, (size, budget) in state.items():
        epochs = budget // size
        left = budget - epochs * size
        for k in sorted((k for k in keys if k.source == source), key=lambda k: (k.key, k.doc_id, k.size)):
            extra = max(0, min(k.size, left))
            left -= extra
            want[k.doc_id, source, k.size, epochs * k.size + extra] += 1
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in found) == want


def test_heavier_documents_come_more_often(spark):
    rows = [(i, "a b", s, 0.9 if i % 2 else 0.1) for i in range(4000) for s in "ab"]
    found = [r for r in mixed(spark, rows, source_weights=(1, 3)) if r.source == "a"]
    heavy = sum(r.taken for r in found if r.doc_id % 2)
    share = sum(r.taken for r in found) / sum(r.size for r in found)
    assert share == pytest.approx(0.5, abs=0.01) and heavy / sum(r.taken for r in found) > 0.75


def test_reruns_and_partitions_agree(spark):
    rows = [(i, "w " * (i % 31), f"s{i % 4}", 0.5) for i in range(1000)]
    first = {(r.doc_id, r.taken) for r in mixed(spark, rows)}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert {(r.doc_id, r.taken) for r in mixed(spark, list(reversed(rows)))} == first
        assert {(r.doc_id, r.taken) for r in mixed(spark, rows, seed="other")} != first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_defined_cases(spark, messy, empty):
    found = mixing.mix_sources(messy, mixing.word_count("text"), mixing.quality_weight("text")).collect()
    assert len(found) == messy.count()
    total = sum(r.size for r in found)
    assert sum(r.taken for r in found) == total and {r.target for r in found} == {float(total)}
    assert all(r.taken == r.size for r in found)
    assert mixing.mix_sources(empty, mixing.word_count("text"), mixing.quality_weight("text")).collect() == []
    nothing = mixed(spark, [(1, "", "a", None), (None, None, None, -1.0), (1, "", "a", None)])
    assert [(r.size, r.source_size, r.target, r.taken) for r in nothing] == [(0, 0, 0.0, 0)] * 3
    same = mixed(spark, [(7, "a b c", "a", 1.0)] * 50 + [(8, "a", "b", 1.0)])
    assert sum(r.taken for r in same) == 151 and max(r.taken for r in same) == 3
