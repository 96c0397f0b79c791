import base64
import importlib
import sys

import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from tabwright.llm import decontaminate, language_crf
from test_near_dup import classes


def expected(spark, rows):
    """The stages one after the other, each but the first by a plain version."""
    model = language_crf.fit_documents(spark.createDataFrame(rows))
    names, scores = model.predict([r.text or "" for r in rows])
    rows = [r for r, name, score in zip(rows, names, scores) if name != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    last = {}
    for r in rows:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    rows = sorted((r for r in rows if last[r.text] == r.doc_id), key=lambda r: r.doc_id)
    rows = [r for i, (r, c) in enumerate(zip(rows, classes([r.text for r in rows]))) if c == i]
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    return {r.doc_id: r for r in rows if not any(b in decontaminate.normal(r.text) for b in bench)}


def test_pipeline_equals_plain_stages(spark, documents):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    want = expected(spark, documents.collect())
    assert {r.doc_id for r in found} == set(want) and len(found) == len(want)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in found:
        assert row.round_trip and row.ids == library.encode_ordinary(row.text) and row.n_tokens == len(row.ids)
        assert row.text == want[row.doc_id].text and row.source == want[row.doc_id].source


def test_stages_keep_columns_and_take_odd_rows(spark, messy, empty, tmp_path):
    for kind, docs in (("messy", messy), ("empty", empty)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == columns, name
            out.write.parquet(folder := str(tmp_path / f"{name}-{kind}"))
            docs = spark.read.parquet(folder)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
        assert bool(last) == (kind == "messy") and all(r.round_trip for r in last)
    assert len(corpus_pipeline.STAGES) == 5


def test_entry_without_the_text_operators(monkeypatch):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tabwright.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "tabwright.llm", None)
    spec = importlib.util.spec_from_file_location("entry_alone", __spark_entry__.__file__)
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    left = set(alone.queries())
    assert left and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in left)
    assert set(alone.oracle_sql()) <= left
