import hashlib
import random
import re
import time

import numpy as np

from tabwright.llm import pii_weak as pii
from tabwright.llm.queries import QUERIES

# The definitions of the base kinds, as they stand.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def plain(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(g) <= 255 for g in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]


def test_base_spans_equal_their_definition():
    rng = random.Random(2)
    parts = ["1", "2", "25", "255", "4111111111111111", " ", "-", ".", "@", "a", "b.c", "_", "+", "(", ")", "é", "\n", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text), text


def test_query_keeps_all_base_spans(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op4_pii_weak"](spark, "/root/testdata/sf0.001").collect()}
    some = 0
    for doc in documents.collect():
        want, row = plain(doc.text), rows[doc.doc_id]
        written = [f"{k}:{a}:{b}" for k, a, b in want]
        assert row.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for k, _, _ in want) for kind in pii.BASE_KINDS]
        assert set(written) <= set(filter(None, row.spans.split(",")))
        some += len(want)
    assert some and len(rows) == documents.count()


def test_time_in_proportion_to_the_text():
    text = "x" * 200_000 + "1" * 200_000 + "+1" + "(" * 100_000 + "@" * 5000 + "a.b" * 50_000 + "1." * 100_000 + "A" * 50_000
    pii.voted_spans(text)  # a quadratic pattern would not end


def test_votes_estimate_and_classifier():
    true = ["write to jane (at) example (dot) org please", "call 415-555-2671 now", "my ssn is 123-45-6789.", "iban DE89370400440532013000 is it", "dear Mary Smith, hello"]
    false = ["version 555-12-3456 of part 4111111111111112x", "order 4111111111111112 it"]
    base = [f"mail to a{k}@example.com or +1 555 {k:03d} 4567 here" for k in range(60)]
    spans = {t: pii.voted_spans(t) for t in true + false + base}
    counted = {}
    for found in spans.values():
        for s in found:
            counted[s["kind"], s["votes"]] = counted.get((s["kind"], s["votes"]), 0) + 1
    likely = pii.estimate(sorted((k, v, n) for (k, v), n in counted.items()))
    classifier = pii.train([(s["features"], likely[s["kind"], s["votes"]]) for found in spans.values() for s in found])
    for text in true:
        assert [s["base"] for s in pii.decide(spans[text], classifier, 0.9)] == [False], text
    for text in false:
        assert pii.decide(spans[text], classifier, 0.9) == [], text
    assert pii.estimate([]) == {} and not np.any(pii.train([]).weights)


def test_defined_cases(messy, empty, tmp_path):
    rows = pii.personal_data(messy, storage=str(tmp_path / "a")).collect()
    assert len(rows) == messy.count()
    kinds = [sorted(s.kind for s in r.spans) for r in rows if r.spans]
    assert kinds == [["email", "phone"]]
    assert pii.personal_data(empty, storage=str(tmp_path / "b")).collect() == []


def test_overlapping_spans_in_proportion(monkeypatch):
    rng = random.Random(12)
    classifier = pii.SpanClassifier(np.zeros(pii.SLOTS))
    span = lambda start, end: {"kind": "phone", "start": start, "end": end, "base": False, "features": []}
    monkeypatch.setattr(pii.SpanClassifier, "probability", lambda self, slots: 0.9)
    spans = [span(a, a + rng.randint(1, 9)) for a in (rng.randrange(600) for _ in range(400))]
    chosen, occupied = [], []
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if all(s["end"] <= a or s["start"] >= b for a, b in occupied):
            occupied.append((s["start"], s["end"]))
            chosen.append(s)
    assert pii.decide(spans, classifier, 0.5) == chosen
    began = time.time()
    assert len(pii.decide([span(10 * i, 10 * i + 5) for i in range(100_000)], classifier, 0.5)) == 100_000
    assert time.time() - began < 10
