import zlib

import numpy as np
import pytest

from tabwright.llm import language_crf as crf
from tabwright.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(documents):
    return crf.fit_documents(documents)


def test_blocks_give_the_marginals_of_a_plain_chain():
    rng = np.random.default_rng(0)
    scores, moves, starts = rng.normal(size=(300, 3)), rng.normal(size=(4, 3)), np.zeros(300, bool)
    starts[[0, 50, 51, 190]] = True
    step, first = np.exp(moves[:3]), np.exp(moves[3])
    ahead, back = np.zeros((300, 3)), np.ones((300, 3))
    for t in range(300):
        ahead[t] = np.exp(scores[t]) * (first if starts[t] else ahead[t - 1] @ step)
        ahead[t] /= ahead[t].sum()
    for t in range(298, -1, -1):
        back[t] = 1 if starts[t + 1] else step @ (np.exp(scores[t + 1]) * back[t + 1])
        back[t] /= back[t].sum()
    both = ahead * back
    assert np.allclose(crf.marginals(scores, moves, starts), both / both.sum(axis=1, keepdims=True), atol=1e-12)


def test_held_out_rows(spark, documents):
    found = {r.doc_id: r for r in QUERIES["op3_language_crf"](spark, "/root/testdata/sf0.001").collect()}
    truth = {r.doc_id: r.lang for r in documents.collect()}
    assert set(found) == set(truth)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in found.items() if r.held_out} == set(held)
    assert np.mean([found[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_code_switched_words(spark, documents, model):
    texts = {lang: next(r.text for r in documents.collect() if r.lang == lang and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.n_chars > 300) for lang in ("de", "es")}
    half = {lang: " ".join(text.split()[:20]) for lang, text in texts.items()}
    mixed = spark.createDataFrame([(half["de"] + " " + half["es"],)], "text string")
    labelled = mixed.select(crf.label_words("text", model, spark).alias("w")).first().w
    share = lambda words, lang: np.mean([w.lang == lang for w in words])
    cut = len(half["de"])
    assert share([w for w in labelled if w.start < cut], "de") > 0.8 and share([w for w in labelled if w.start > cut], "es") > 0.8


def test_defined_cases(spark, messy, empty, model):
    rows = messy.select("doc_id", "text", crf.predict("text", model, spark).alias("p")).collect()
    for row in rows:
        letters = any(map(str.isalpha, row.text or ""))
        assert (row.p.lang == "und") == (not letters) and (row.p.score == 0) == (not letters)
    assert crf.fit_documents(empty).languages == []
    nothing = messy.select(crf.predict("text", crf.fit_documents(empty), spark).alias("p")).collect()
    assert {r.p.lang for r in nothing} == {"und"}
    assert empty.select(crf.predict("text", model, spark)).collect() == []
    one = crf.fit([("en", "the one and only words here")])
    assert one.predict(["any word", "²³ 12"]) == (["en", "und"], [1.0, 0.0])


def test_the_sample_is_bounded_and_leaves_held_out_rows_alone(documents):
    sample = crf.fit_sample(documents, rows_each=3)
    assert {lang for lang, _ in sample} == {"de", "en", "es", "fr"} and len(sample) <= 12
    held = {r.text for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    usable = {r.text for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert all(text in usable for _, text in sample) and not {t for _, t in crf.fit_sample(documents)} & (held - usable)
