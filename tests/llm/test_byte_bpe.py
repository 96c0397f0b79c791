import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tabwright.llm import byte_bpe
from tabwright.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain():
    with open(VOCABULARY[0], "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=VOCABULARY[1], mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_plain_library_on_odd_texts():
    rng = random.Random(1)
    parts = ["a", "B1", " '", "'s", "é", "ß", "日本", "!!", " ", "  ", "\n", "\t", "\x85", "\xa0", " ", "\x1c", "--", "====", "<|endoftext|>", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + ["=" * n for n in range(1, 130)]
    library, own = plain(), byte_bpe.load(*VOCABULARY)
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode_ordinary(text), text


def test_a_full_store_changes_nothing(monkeypatch, words):
    texts = [words(300, seed) for seed in range(8)]
    own = byte_bpe.ByteBPE(*VOCABULARY)
    whole = own.encode(texts)
    monkeypatch.setattr(byte_bpe, "STORE_UNITS", 50)
    small = byte_bpe.ByteBPE(*VOCABULARY)
    assert [small.encode([t])[0] for t in texts] == whole


def test_query_over_documents(spark, documents):
    library = plain()
    found = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for row in documents.collect():
        ids = library.encode_ordinary(row.text)
        got = found.pop(row.doc_id)
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()
    assert not found


def test_defined_cases(messy, empty):
    rows = messy.select("text", byte_bpe.encode("text", *VOCABULARY).alias("new")).select("text", "new", byte_bpe.decode("new", *VOCABULARY).alias("back")).collect()
    assert len(rows) == 11
    for row in rows:
        assert bytes(row.back).decode() == (row.text or "")
        assert bool(row.new) == bool(row.text)
    assert empty.select(byte_bpe.encode("text", *VOCABULARY)).collect() == []


def test_one_worker_for_both_ways_gives_the_same(messy, empty):
    both = byte_bpe.encode_and_decode("text", *VOCABULARY)
    for row in messy.select("text", byte_bpe.encode("text", *VOCABULARY).alias("one"), both.alias("both")).collect():
        assert row.both.ids == row.one and bytes(row.both.decoded).decode() == (row.text or "")
    assert empty.select(both).collect() == []


def test_offsets_cover_split_characters(spark):
    text = "naïve 日本語 😀 x"
    row = spark.createDataFrame([(text,)], "text string").select(byte_bpe.encode_with_offsets("text", *VOCABULARY).alias("o")).first().o
    table = byte_bpe.load(*VOCABULARY).token_bytes
    assert row.starts[0] == 0 and row.ends[-1] == len(text)
    for token, start, end in zip(row.ids, row.starts, row.ends):
        assert table[token] in text[start:end].encode()
    assert any(a == b for a, b in zip(row.starts, row.starts[1:]))  # one character, several tokens


def test_decoding_of_cut_null_and_unknown_ids(spark):
    ids = np.frombuffer(byte_bpe.load(*VOCABULARY).encode(["日"])[0], "<i4").tolist()
    assert len(ids) > 1
    frame = spark.createDataFrame([(0, ids), (1, ids[:1]), (2, None), (3, []), (4, [None, *ids]), (5, [10**6, -1])], "k int, ids array<int>")
    texts = {r.k: r.text for r in frame.select("k", byte_bpe.decode_text("ids", *VOCABULARY).alias("text")).collect()}
    assert texts[0] == texts[4] == "日" and "�" in texts[1] and texts[2] == texts[3] == "" and texts[5] == "��"
    assert frame.select(F.sum(F.length(byte_bpe.decode("ids", *VOCABULARY)))).first()[0] > 0
