import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tabwright.llm import near_dup


def multiset(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def alike(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


def classes(texts, threshold=0.8):
    """Components of all pairs, by plain comparison; named by position."""
    sets, parent = [multiset(t) for t in texts], list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        if alike(sets[a], sets[b]) >= threshold:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"new{rng.random():.9f}" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def families(words):
    """Chains of copies of copies around the threshold, a large family, shared passages, repeated shingles, short texts."""
    passage = words(60, 999)
    texts = [words(150, s) for s in range(30)]
    for s in range(12):
        text = words(120, 100 + s)
        for step in range(6):
            texts.append(text)
            text = edited(text, 0.022, 1000 * s + step)
    base = words(200, 77)
    texts += [edited(base, 0.01, 5000 + k) for k in range(80)]
    texts += [f"{passage} {words(30, 300 + k)}" for k in range(60)]
    texts += [("a b c d e f " * k).strip() for k in range(1, 25)] + ["one", "one two", "One  TWO", "x y z w v", "x y z w v u"]
    return texts


def test_classes_equal_plain_comparison_of_all_pairs(make, families, tmp_path):
    order = list(range(len(families)))
    random.Random(4).shuffle(order)
    docs = make([(i, families[i], "en") for i in order]).repartition(5)
    rows = {r.id: r for r in near_dup.near_duplicates(docs, storage=str(tmp_path / "a")).collect()}
    want = classes(families)
    assert [rows[i].class_id for i in range(len(families))] == want
    sizes = Counter(want)
    assert all(rows[i].class_size == sizes[want[i]] and rows[i].kept == (i == want[i]) for i in rows)


def test_hubs_alone_would_lose_links(make, families, tmp_path):
    """The passes after the first one matter on this input or find nothing new; either way the first alone never has more."""
    run = near_dup.NearDuplicates(make([(i, t, "en") for i, t in enumerate(families)]), "doc_id", "text", 0.8, str(tmp_path / "a"))
    run.sketches()
    run.candidates()
    first = run.verified(run.members.filter("node != hub").select("node", "hub")).count()
    run.links = None
    run.candidates()
    run.join()
    assert run.links.count() >= first > 0


def test_nodes_beside_a_large_class_are_not_compared_with_all_of_it(make, words, tmp_path, monkeypatch):
    """Copies with more edits than the rest reach a few members each: slices of the class find one, and the classes are those of all pairs."""
    base, rng, texts = words(150, 4242).split(), random.Random(9), []
    for _ in range(400):
        copy = list(base)
        for place in rng.sample(range(150), rng.choice((1, 2, 3))):
            copy[place] = f"new{rng.random():.9f}"
        texts.append(" ".join(copy))
    compared, verified = [], near_dup.NearDuplicates.verified

    def counted(self, pairs, sets=None):
        compared.append(0 if sets is None else pairs.count())
        return verified(self, pairs, sets)

    monkeypatch.setattr(near_dup.NearDuplicates, "verified", counted)
    monkeypatch.setattr(near_dup, "HUB_PASSES", 1)
    rows = {r.id: r.class_id for r in near_dup.near_duplicates(make(list(zip(range(400), texts, ["en"] * 400))), storage=str(tmp_path / "a")).collect()}
    want = classes(texts)
    assert [rows[i] for i in range(400)] == want and max(Counter(want).values()) > 300
    assert sum(compared) < 6000


@pytest.mark.parametrize("limit", [200_000, 0])
def test_later_links_work_on_classes_not_on_all_links_again(spark, make, tmp_path, monkeypatch, limit):
    """By one task or in rounds, with or without a broadcast, the labels are those of all links; what is written follows the pass's own links."""
    monkeypatch.setattr(near_dup, "ONE_TASK_LINKS", limit)
    monkeypatch.setattr(near_dup, "SENT_LABELS", limit)
    run = near_dup.NearDuplicates(make([(1, "a text", "en")]), "doc_id", "text", 0.8, str(tmp_path / "a"))
    kept, keep = [], near_dup.NearDuplicates.keep

    def counted(self, df, name, *more):
        table = keep(self, df, name, *more)
        kept.append((name, table.count()))
        return table

    monkeypatch.setattr(near_dup.NearDuplicates, "keep", counted)
    rng = random.Random(3)
    passes = [[(k, k + 1) for k in range(0, 300, 2)], [(k, k + 2) for k in range(0, 40, 2)], [tuple(sorted(rng.sample(range(320), 2))) for _ in range(15)], [(0, 1)]]
    top = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    labels = None
    for links in passes:
        kept.clear()
        labels = run.classes(spark.createDataFrame(links, "node bigint, hub bigint"), labels)
        for a, b in links:
            a, b = sorted((find(a), find(b)))
            top[a], top[b] = a, a
        assert {r.node: r.label for r in labels.collect()} == {x: find(x) for x in top}
        assert all(n <= 2 * len(links) for name, n in kept if name in ("edges", "ends", "reached", "heard"))
    assert kept == [("edges", 0)]


def test_ranks_of_slots_come_as_a_byte_each(spark):
    """20 sets hold the first shingle, 10 the second, 3 the last; the driver gets blocks of bytes, not a row for each frequent slot."""
    last = near_dup.SLOTS - 1
    held = [[h for h, most in ((7, 20), (last, 10), (70_000, 3)) if k < most] for k in range(20)]
    sets = [(np.array(sorted(h), "<u8").tobytes() + np.ones(len(h), "<u4").tobytes(),) for h in held]
    ranks = near_dup.frequent_slots(spark.createDataFrame(sets, "shingles binary").coalesce(1))
    assert ranks.nbytes == near_dup.SLOTS and np.flatnonzero(ranks).tolist() == [7, last] and ranks[7] > ranks[last]


def test_signatures_are_unbiased_for_weights():
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(200):
        hashes = rng.integers(1, 1 << 44, 30, dtype=np.uint64)
        a, b = rng.integers(0, 9, 30), rng.integers(0, 9, 30)
        owner = np.repeat([0, 1], 30)
        counts = np.concatenate([a, b])
        keep = counts > 0
        found = near_dup.signatures(owner[keep], np.concatenate([hashes, hashes])[keep], counts[keep], 2)
        pairs.append((np.minimum(a, b).sum() / np.maximum(a, b).sum(), (found[0] == found[1]).mean()))
    true, seen = np.array(pairs).T
    assert abs((seen - true).mean()) < 0.006  # three standard errors
    assert abs(seen - true).max() < 0.16


def test_defined_cases(messy, empty, tmp_path):
    rows = near_dup.near_duplicates(messy, storage=str(tmp_path / "a")).collect()
    assert len(rows) == messy.count()
    assert all(r.class_size == 1 and r.kept and r.class_id == r.id for r in rows if r.id in (3, 4, 5, 6))
    fox = [r for r in rows if r.class_size == 3]
    assert sorted(r.id for r in fox) == [1, 2, 2] and {r.class_id for r in fox} == {1} and sum(r.kept for r in fox) == 1
    assert near_dup.near_duplicates(empty, storage=str(tmp_path / "b")).collect() == []


def test_rows_that_stay_keep_their_columns(make, families, tmp_path):
    docs = make([(i, t, "en") for i, t in enumerate(families)])
    left = near_dup.drop_near_duplicates(docs, storage=str(tmp_path / "a"))
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(classes(families)))


def test_near_copies_without_or_with_a_shared_id_go(make, words, tmp_path):
    base, other = words(200, 7), words(200, 8)
    near = [edited(base, 0.005, k) for k in range(12)]
    rows = [(None, t) for t in near[:4]] + [(5, t) for t in near[4:8]] + [(k, t) for k, t in enumerate(near[8:], 20)]
    rows += [(5, other), (5, other.upper()), (None, words(200, 9)), (None, None), (None, None), (5, "")]
    docs = make([(i, t, "en") for i, t in rows])
    left = near_dup.drop_near_duplicates(docs, storage=str(tmp_path / "a")).collect()
    found = [r.text for r in left]
    assert len(left) == 6 and sum(t in near for t in found) == 1 and sum(t in (other, other.upper()) for t in found) == 1
    assert found.count(None) == 2 and found.count("") == 1 and words(200, 9) in found
