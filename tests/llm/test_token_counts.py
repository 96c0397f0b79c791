import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tabwright.llm import token_counts
from tabwright.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_every_prefix_equals_the_library(words):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(2)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.vocab_size())]
    texts = ["".join(rng.choices(pieces, k=6)) for _ in range(150)] + ["日本 ▁▁ a\n\n b   ", "<s> <0x0A> <unk>", "    ", "\x00a", "😀😀", words(40, 1)]
    for text, steps in zip(texts, token_counts.load(PATH).tables(texts)):
        counts = steps.cumsum(dtype=int)
        assert [len(library.encode(text[:i])) for i in range(1, len(text) + 1)] == counts.tolist(), text


def test_a_full_store_changes_nothing(monkeypatch, words):
    texts = [words(300, seed) for seed in range(8)]
    whole = [t.tolist() for t in token_counts.PrefixCounter(PATH).tables(texts)]
    monkeypatch.setattr(token_counts, "STORE_CHUNKS", 40)
    small = token_counts.PrefixCounter(PATH)
    assert [small.tables([t])[0].tolist() for t in texts] == whole


def test_query_over_documents(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = QUERIES["op6_prefix_counts"](spark, "/root/testdata/sf0.001").collect()
    want = {r.doc_id: (len(r.text.encode()), len(library.encode(r.text))) for r in documents.collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)


def test_cuts_and_budgets_without_encoding(messy, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    counted = messy.select("text", token_counts.count_prefixes("text", PATH).alias("c"))
    asked = counted.select(
        "text",
        "c.n_tokens",
        token_counts.tokens_of_prefix(F.col("c.prefix_delta"), F.lit(7)).alias("seven"),
        token_counts.longest_prefix(F.col("c.prefix_delta"), F.lit(5)).alias("five"),
        token_counts.longest_prefix(F.col("c.prefix_delta"), F.lit(None).cast("bigint")).alias("none"),
    ).collect()
    for row in asked:
        text = row.text or ""
        assert row.n_tokens == len(library.encode(text)) and row.none is None
        assert row.seven == len(library.encode(text[:7]))
        few = text[:200]
        assert row.five == max((i for i in range(len(few) + 1) if len(library.encode(few[:i])) <= 5), default=0)
    assert empty.select(token_counts.count_prefixes("text", PATH)).collect() == []
