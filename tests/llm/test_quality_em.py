import numpy as np

from tabwright.llm import quality_em
from tabwright.llm.queries import QUERIES


def test_estimate_recovers_hidden_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    ballots = np.where(truth[:, None], rng.random((20_000, 5)) < 0.999, rng.random((20_000, 5)) < [0.2, 0.3, 0.5, 0.7, 0.9]).astype(int)
    patterns, count = np.unique(ballots, axis=0, return_counts=True)
    found = quality_em.estimate(patterns, count.astype(float))
    assert abs(found.share - 0.8) < 0.05 and np.abs(found.if_bad - [0.2, 0.3, 0.5, 0.7, 0.9]).max() < 0.1
    assert ((found.posterior(ballots) > 0.5) == truth).mean() > 0.95


def test_labelled_rows_that_no_fit_has_seen(spark):
    """Labels are not read by the operator, so all of them are held out."""
    scored = QUERIES["op1_quality_em"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15
    assert scored.count() == 1000


def test_defined_cases(messy, empty, tmp_path):
    rows = quality_em.quality(messy, storage=str(tmp_path / "a")).collect()
    assert len(rows) == messy.count()
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    assert all(r.score == 0 and not r.kept for r in rows if r.doc_id in (3, 4, 5))
    assert quality_em.quality(empty, storage=str(tmp_path / "b")).collect() == []


def test_every_row_has_the_posterior_of_its_own_votes(spark, tmp_path):
    """Also rows that share an id or have none."""
    sound, faulty = "The cat sat on the mat today. It was warm.", "1234 5678 #### 9012 %%%% 3456 && 7890 ||||"
    docs = spark.createDataFrame([(i, t) for t in (sound, faulty) for i in [None, 7] * 20 + list(range(100, 200))], "doc_id bigint, text string")
    rows = quality_em.quality(docs, storage=str(tmp_path / "votes")).collect()
    assert len(rows) == docs.count()
    for doc_id, n in ((None, 20), (7, 20), (150, 1)):
        found = sorted(r.posterior for r in rows if r.doc_id == doc_id)
        assert len(found) == 2 * n and max(found[:n]) < 0.5 < min(found[n:])


def test_letters_of_all_scripts_have_a_shape():
    shape = lambda word: quality_em.REPEATED.sub(r"\1", word.translate(quality_em.SHAPES))
    assert [shape(w) for w in ("Hello,", "été", "привет!", "λόγος", "日本語", "x42", "a_b")] == ["Aa,", "a", "a!", "a", "a", "a0", "a_a"]
    assert quality_em.token_slots("привет")[2] == quality_em.token_slots("日本")[2] == quality_em.token_slots("word")[2]


def test_scorer_on_short_fits(words):
    clean, noisy = [words(30, s) for s in range(40)], [words(30, s).replace(" ", "### ") for s in range(40, 80)]
    scorer = quality_em.train([(t, 1.0) for t in clean] + [(t, 0.0) for t in noisy])
    assert min(map(scorer.score, clean)) > 0.5 > max(map(scorer.score, noisy))
    assert scorer.score("") == 0 and quality_em.train([]).score("a") == 0.5
