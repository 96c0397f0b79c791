import random

import pytest

from tabwright.llm import decontaminate
from tabwright.llm.queries import QUERIES


def edits(item, text):
    """Fewest edits between the item and any part of the text, by the plain table."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(400):
        item, text = ("".join(rng.choices("abc", k=rng.randint(low, 80))) for low in (1, 0))
        bits = {c: sum(1 << i for i, x in enumerate(item) if x == c) for c in item}
        assert decontaminate.distance_within(bits, len(item), text)[0] == edits(item, text)


def test_matches_equal_the_plain_table(spark, make):
    rng = random.Random(2)
    items = [(k, "".join(rng.choices("abcd ", k=rng.randint(25, 90)))) for k in range(6)]
    texts = []
    for n in range(60):
        text = ""
        for _, item in rng.sample(items, 2):
            for _ in range(rng.randint(0, int(0.14 * len(item)))):
                at = rng.randrange(len(item))
                item = item[:at] + rng.choice(["", "z", item[at] + "y"]) + item[at + 1 :]
            text += item.upper() if n % 2 else item
            text += "".join(rng.choices("efg  \n", k=rng.randint(0, 30)))
        texts.append((n, text, "en"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rate = 0.1
    want = {}
    for n, text, _ in texts:
        for k, item in items:
            found, size = edits(decontaminate.normal(item), decontaminate.normal(text)), len(decontaminate.normal(item))
            if found <= int(rate * size):
                want[n, k] = found
    for block in (1 << 20, 150):  # all items at once, and in several blocks
        rows = decontaminate.contaminated(make(texts), bench, error_rate=rate, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id): r.edits for r in rows} == want and len(rows) == len(want)


def test_query_over_documents(spark, documents):
    bench = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    exact = {(r.doc_id, k) for r in documents.collect() for k, item in bench if item in decontaminate.normal(r.text)}
    rows = QUERIES["op8_pigeonhole_edits"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.edits == 0} == exact
    texts = {r.doc_id: decontaminate.normal(r.text) for r in documents.collect()}
    for row in rows:
        assert edits(dict(bench)[row.item_id], texts[row.doc_id]) == row.edits


def test_defined_cases(spark, messy, empty):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "the QUICK brown\nfox jumps over the lazy dog."), (3, "the quick brown fox jumps over the lazy dog."), (4, "q")], "item_id bigint, text string")
    rows = decontaminate.contaminated(messy, odd).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows if r.item_id == 3) == [(1, 3), (1, 3), (2, 3), (2, 3), (2, 3), (2, 3)]
    assert decontaminate.contaminated(empty, odd).collect() == []
    assert decontaminate.contaminated(messy, odd.limit(0)).collect() == []
    left = decontaminate.drop_contaminated(messy, odd.filter("item_id = 3"))
    assert left.columns == messy.columns and left.count() == 8


@pytest.mark.parametrize("size", [1, 19, 20, 21])
def test_short_items(size):
    item = "abcdefghijklmnopqrstu"[:size]
    assert decontaminate.Matcher([(9, item)], 0.05).find("zz " + item)[0][:2] == (9, 0)
