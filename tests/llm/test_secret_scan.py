import hashlib
import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tabwright.llm import secret_scan
from tabwright.llm.queries import QUERIES, written

# The definitions of the base kinds, as they stand.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
KINDS = ["assign", "access", "hex"]


def plain(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m.group()) >= 16]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def test_spans_equal_their_definition(make):
    rng = random.Random(3)
    parts = ["token", "API_key", "secret: ", "password=", '"', "'", " ", "=", ":", "AKIA", "ABCD1234EFGH5678", "0a1b2c3d4e5f6071", "deadbeef", "xyz", "é😀", "\n", "."]
    texts = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30))), "en") for i in range(1500)]
    texts.append((9000, "token=abcdefghijklmnop " * 1200, "en"))
    rows = {r.doc_id: r.spans for r in secret_scan.find_secrets(make(texts)).select("doc_id", written(F.filter("spans", lambda s: s.place < 3)).alias("spans")).collect()}
    for i, text, _ in texts:
        assert rows[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text)), text[:300]


def test_entropy_of_the_best_window(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(secret_scan.ALPHABET[: rng.randint(2, 66)], k=rng.randint(20, 90))) for _ in range(40)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secret_scan.best_entropy(F.col("t")).alias("e"))
    for row in frame.collect():
        assert abs(row.e - max(entropy(row.t[i : i + 20]) for i in range(len(row.t) - 19))) < 1e-9


def test_time_in_proportion_to_a_long_candidate(make):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwyzABCDEFGHIJKLMNOPQRSTUVWYZ0123456789"  # xxxx is on the allow-list
    low = "aB1cD2" * 170_000
    cases = ["".join(rng.choices(letters, k=n)) for n in (1000, 1023, 1024, 1043, 1044, 3000, 1_000_000)]
    cases += [low[:500_000] + cases[0][:20] + low[:500_000], low]
    began = time.time()
    rows = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.find_secrets(make([(i, f"see {c} there", "en") for i, c in enumerate(cases)])).collect()}
    assert time.time() - began < 60
    for i, text in enumerate(cases[:-1]):
        assert rows[i] == [("entropy", 4, 4 + len(text))]
    assert rows[len(cases) - 1] == []


def test_windows_across_pieces(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices(secret_scan.ALPHABET[: rng.randint(2, 66)], k=rng.choice([1023, 1024, 1025, 2100]))) for _ in range(12)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", secret_scan.best_entropy(F.col("t")).alias("e"))
    for row in frame.collect():
        assert abs(row.e - max(entropy(row.t[i : i + 20]) for i in range(len(row.t) - 19))) < 1e-9


def whole(text):
    """All spans by their definition: base spans, and candidates beside them by the entropy of every window."""
    base = plain(text)
    found = [(s[1], KINDS.index(s[0]), s[2], s[0]) for s in base]
    for m in re.finditer(secret_scan.CANDIDATE, text):
        value = m.group()
        if any(a < m.end() and m.start() < b for _, a, b in base) or any(re.search(p.replace(r"\z", r"\Z"), value) for p in secret_scan.ALLOWED) or not re.search(secret_scan.NO_WORD, value):
            continue
        least = next(least for _, pattern, least in secret_scan.CLASSES if re.fullmatch(pattern, value))
        if max(entropy(value[i : i + 20]) for i in range(len(value) - 19)) >= least:
            found.append((m.start(), 3, m.end(), "entropy"))
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))


def test_all_spans_of_the_query(spark, documents, make):
    rows = {r.doc_id: r.spans for r in QUERIES["op9_entropy_secrets"](spark, "/root/testdata/sf0.001").collect()}
    assert all(rows[d.doc_id] == whole(d.text) for d in documents.collect())
    rng = random.Random(10)
    parts = ["token=", " ", "Zk8qP2vN5xT9wR3mY7cL1bH6", "aB1aB1", "0a1b2c3d4e5f6071", "/", "-", "words", "9F2C47A0B1D83E65F7A4", "2024", "_"]
    texts = [(i, "".join(rng.choices(parts, k=rng.randint(1, 12))), "en") for i in range(600)]
    found = {r.doc_id: r.spans for r in secret_scan.find_secrets(make(texts)).select("doc_id", written(F.col("spans")).alias("spans")).collect()}
    assert all(found[i] == whole(text) for i, text, _ in texts) and sum("entropy" in f for f in found.values()) > 50


def test_added_and_suppressed_candidates(make):
    cases = {
        "key Zk8qP2vN5xT9wR3mY7cL1bH6 here": 1,  # letters and digits
        "key 9F2C47A0B1D83E65F7A4 here": 1,  # upper-case hexadecimal
        "key pQ7/x+Zk2-Lm9_Tr4=Vb8wYc here": 1,
        "internationalisierungsbeauftragter": 0,
        "one_two_three_four_five-six/seven": 0,
        "2024-01-01/2024-12-31_00000000": 0,
        "--------------------------------": 0,
        "550E8400-E29B-41D4-A716-446655440000": 0,
        "AbcExample9KeyPlaceholder12345": 0,
        "aB1aB1aB1aB1aB1aB1aB1aB1": 0,  # little entropy
        'token = "Zk8qP2vN5xT9wR3mY7cL1bH6"': 0,  # inside a base span
    }
    docs = make([(i, text, "en") for i, text in enumerate(cases)])
    rows = {r.doc_id: [s.kind for s in r.spans].count("entropy") for r in secret_scan.find_secrets(docs).collect()}
    assert [rows[i] for i in range(len(cases))] == list(cases.values())


def test_query_over_documents(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op9_entropy_secrets"](spark, "/root/testdata/sf0.001").collect()}
    for doc in documents.collect():
        want, row = plain(doc.text), rows[doc.doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == kind for k, _, _ in want) for kind in KINDS]


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op9_entropy_secrets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_defined_cases(messy, empty):
    rows = secret_scan.find_secrets(messy).collect()
    assert len(rows) == messy.count() and not any(r.spans for r in rows)
    assert secret_scan.find_secrets(empty).collect() == []
