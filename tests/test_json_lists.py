import json
import random

import pytest

from tabwright.sources import json_lists
from tabwright.sources.readers import read_json_batches, read_large_json_batches


@pytest.fixture()
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def odd_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "语", " ", "\n", 'houses": [', "a"]) for _ in range(rng.randrange(30)))
    if kind == 3:
        return rng.choice([None, True, 1.5, 7])
    if kind == 4:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["houses", "a}", 'b"', "c\\"]): odd_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def odd_bodies(rng):
    for i in range(12):
        houses = [{"i": n, **{f"v{k}": odd_value(rng) for k in range(rng.randrange(5))}} for n in range(rng.choice([0, 1, 5, 60]))]
        body = {"houses": houses}
        if i % 3 == 1:
            body = {"before": odd_value(rng), "also": [{"houses": [{"i": -1}]}, {"x": 1}], **body}
        if i % 3 == 2:
            body = {**body, "after": [{"i": -2}, {"i": -3}], "last": odd_value(rng)}
        yield json.dumps(body, ensure_ascii=bool(i % 2), indent=rng.choice([None, 1])) + rng.choice(["", "\n", " \n\n"]), houses


@pytest.mark.parametrize("sent", [json_lists.SENT_RANGES, 0])
def test_records_of_a_list_from_many_ranges(spark, tmp_path, small_ranges, monkeypatch, sent):
    monkeypatch.setattr(json_lists, "SENT_RANGES", sent)
    wanted = {}
    for i, (text, houses) in enumerate(odd_bodies(random.Random(3))):
        (tmp_path / f"f{i}.json").write_text(text, encoding="utf-8")
        wanted |= {(i, n): house for n, house in enumerate(houses)}
    found = json_lists.read_list_records(spark, str(tmp_path)).collect()
    got = {(int(r["source"].rsplit("/f", 1)[1][:-5]), r["position"]): json.loads(r["value"]) for r in found}
    assert all(r["error"] is None for r in found) and len(found) == len(got)
    assert got == wanted


def test_a_record_longer_than_many_ranges_and_broken_files(spark, tmp_path, small_ranges):
    house = {"i": 0, "deep": [{"x": "}" * 3000}, {"y": {"z": '"' * 2000}}], "text": "{" * 5000}
    whole = json.dumps({"houses": [house, {"i": 1}]})
    (tmp_path / "a.json").write_text(whole)
    (tmp_path / "b.json").write_text(whole[:9000])
    (tmp_path / "c.json").write_text('{"houses": [{"i": "open')
    (tmp_path / "d.json").write_text('{"other": [{"i": 1}]}')
    (tmp_path / "e.json").write_text("")
    rows = {(r["source"][-6], r["position"]): r for r in json_lists.read_list_records(spark, str(tmp_path)).collect()}
    assert set(rows) == {("a", 0), ("a", 1), ("b", None), ("c", None)}
    assert json.loads(rows["a", 0]["value"]) == house and rows["a", 0]["error"] is None
    assert rows["b", None]["error"] == rows["c", None]["error"] == "the file is no complete JSON body"


def test_both_json_readers_agree(spark, tmp_path, small_ranges):
    fields = {"LotArea": "int", "note": "string", "more": "string"}
    houses = [{"LotArea": n if n % 9 else "wide", "note": 'a "}" \\ ' * (n % 4), "more": {"k": [n, "]"]}} for n in range(200)]
    (tmp_path / "b.json").write_text(json.dumps({"houses": houses}))
    columns = ["position", *fields, "error"]
    one, other = (f(spark, str(tmp_path), fields).select(columns).orderBy("position").collect() for f in (read_json_batches, read_large_json_batches))
    assert len(one) == 200 and one == other
    assert read_large_json_batches(spark, str(tmp_path), fields).rdd.getNumPartitions() > 5
