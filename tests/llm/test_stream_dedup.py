import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabwright.llm import stream_dedup


def plain(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row.text or ""].append(row.doc_id)
    largest = lambda ids: max((i for i in ids if i is not None), default=None)
    return sorted(((r.doc_id, largest(groups[r.text or ""]), len(groups[r.text or ""])) for r in rows), key=str)


def check(found, rows):
    assert sorted(((r.id, r.keep_id, r.group_size) for r in found), key=str) == plain(rows)
    assert sum(r.kept for r in found) == len({r.text or "" for r in rows})
    assert all(r.id == r.keep_id for r in found if r.kept)


def test_defined_cases(messy, empty, tmp_path):
    rows = messy.collect()
    found = stream_dedup.exact_groups(messy, storage=str(tmp_path / "a")).collect()
    check(found, rows)
    assert {bytes(r.digest).hex() for r in found} == {hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows}
    assert stream_dedup.exact_groups(empty, storage=str(tmp_path / "b")).collect() == []


def test_different_texts_under_one_digest(documents, tmp_path):
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))
    found = stream_dedup.exact_groups(documents, digest=weak, storage=str(tmp_path / "a")).collect()
    check(found, documents.collect())


def test_state_outlives_a_stop(spark, documents, tmp_path):
    """Two starts on parts of the rows, in batches of one file, give the state of all rows."""
    storage = str(tmp_path / "a")
    for part in (0, 1):
        stream_dedup.arrive(documents.filter(f"doc_id % 2 = {part}").repartition(3), storage, f"part-{part}", "doc_id", "text")
        state = stream_dedup.run_stream(spark, storage, files_at_once=1).collect()
    want = {}
    for row in documents.collect():
        key = hashlib.sha256(row.text.encode()).digest()
        size, largest = want.get(key, (0, -1))
        want[key] = (size + 1, max(largest, row.doc_id))
    assert {bytes(r.digest): (r.group_size, r.keep.id) for r in state} == want


def test_rows_that_stay_keep_their_columns(messy, tmp_path):
    left = stream_dedup.drop_copies(messy, storage=str(tmp_path / "a"))
    assert left.columns == messy.columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in messy.collect()})
    assert {r.doc_id for r in left.collect() if r.text and r.text.startswith("the quick")} == {2}


def test_two_calls_on_one_storage_equal_one_over_all_rows(make, messy, tmp_path):
    """Also where different texts have one digest, and copies of a text come with either call."""
    more = make([(9, "", "en"), (2, "the quick brown fox jumps over the lazy dog. again and again", "en"), (12, "new", "en"), (13, None, "en"), (14, "12345 --- 678", "en")])
    everything = messy.collect() + more.collect()
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    for name, digest in (("whole", stream_dedup.sha256), ("weak", weak)):
        first = stream_dedup.exact_groups(messy, digest=digest, storage=str(tmp_path / name))
        check(first.collect(), messy.collect())
        check(stream_dedup.exact_groups(more, digest=digest, storage=str(tmp_path / name)).collect(), everything)
        check(first.collect(), messy.collect())  # an earlier result stays as it was


def test_rows_of_a_second_call_go_if_an_earlier_row_stays(make, tmp_path):
    first, second = make([(5, "a", "en"), (6, "b", "en")]), make([(4, "a", "en"), (6, "b", "en"), (7, "c", "en"), (7, "c", "en")])
    assert stream_dedup.drop_copies(first, storage=str(tmp_path / "a"), batch="one").count() == 2
    left = stream_dedup.drop_copies(second, storage=str(tmp_path / "a"), batch="two")
    found = [(r.doc_id, r.text) for r in left.collect()]
    # Of the repeated row (6, "b") one stays over both calls, here that of the later batch, named after the earlier.
    assert sorted(found) == [(6, "b"), (7, "c")]


def test_a_repeated_call_changes_nothing(messy, documents, tmp_path, monkeypatch):
    storage, rows = str(tmp_path / "a"), messy.collect()
    for _ in range(2):
        check(stream_dedup.exact_groups(messy, storage=storage, batch="one").collect(), rows)

    def stop(*_):
        raise KeyboardInterrupt

    small = documents.limit(20)
    for step in ("run_stream", "differing"):  # before the stream, after it
        with monkeypatch.context() as m:
            m.setattr(stream_dedup, step, stop)
            with pytest.raises(KeyboardInterrupt):
                stream_dedup.exact_groups(small, storage=storage, batch=step)
        before = rows
        rows = rows + small.collect()
        check(stream_dedup.exact_groups(small, storage=storage, batch=step).collect(), rows)
        assert len(before) < len(rows)


def test_a_batch_that_was_cut_off_is_written_anew(spark, make, tmp_path):
    storage, docs = str(tmp_path / "a"), make([(1, "a", "en"), (2, "a", "en")])
    stream_dedup.note(spark, f"{storage}/begun", "one")
    docs.limit(1).write.parquet(f"{storage}/arrivals/one")  # what a lost driver left
    with pytest.raises(RuntimeError, match="one"):
        stream_dedup.exact_groups(docs, storage=storage, batch="two")
    check(stream_dedup.exact_groups(docs, storage=storage, batch="one").collect(), docs.collect())
