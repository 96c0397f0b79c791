"""Personal data by weak supervision.

Exact patterns find the base spans, which always stay.  Looser patterns propose more (spelled-out addresses, local telephone
numbers, national numbers, bank accounts, names).  On every proposed and base span eight labelers vote yes, no or not at all:
patterns, checksums, gazetteers, words before it, its edges and its shape.  Expectation-maximisation over the counts of vote
patterns (at most kinds times 3^8 rows) estimates how reliable each labeler is and how likely each span.  These
likelihoods train a logistic classifier on hashed votes, shape and context, which decides on the proposed spans.

Texts are read once; what is kept of them are spans.  All patterns take time in proportion to the text.

Defined cases: a null or empty text has no spans; proposed spans never overlap base spans or one another (the likelier one
stays, then the earlier, then the longer); a table without spans fits nothing and adds nothing.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.columns import pieces, text_or_empty
from tabwright.session import scratch_path

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_spelled", "phone_local", "national_id", "iban", "person")
KINDS = BASE_KINDS + ADDED_KINDS
#: Least probability of an added span.
LEAST = 0.9
#: Spans that train the classifier, at most; slots for its hashed features.
FIT_SPANS, SLOTS = 20_000, 1 << 14

# Patterns of the base kinds; an address is looked for around each @, groups of an ip along each run.
EMAIL_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_AFTER = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Patterns of the added kinds.
SPELLED = re.compile(r"(?:\(at\)|\[at\]| at )")
SPELLED_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?\Z")
SPELLED_AFTER = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63})+")
LOCAL_PHONE = re.compile(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
GIVEN = re.compile(r"[A-Z][a-z]{1,20}(?= [A-Z][a-z])")
FAMILY = re.compile(r" [A-Z][a-z]{1,20}")

# Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov io co info biz de fr es it uk us ca eu ch at nl be pl ru jp cn in br mx au".split())
GIVEN_NAMES = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas "
    "Sarah Charles Karen Hans Anna Peter Ursula Klaus Monika Jean Marie Pierre Claire Luc Sophie Carlos Ana Jose Carmen Luis Lucia".split()
)
CUES = {
    "email": "email mail e-mail contact correo courriel write".split(),
    "email_spelled": "email mail e-mail contact correo courriel write".split(),
    "ip": "ip address host server adresse direccion".split(),
    "card": "card credit visa mastercard karte carte tarjeta payment".split(),
    "phone": "phone tel telephone call mobile fax telefon telefono".split(),
    "phone_local": "phone tel telephone call mobile fax telefon telefono".split(),
    "national_id": "ssn social security number passport".split(),
    "iban": "iban account bank konto compte cuenta".split(),
    "person": "name mr mrs ms dr dear sincerely author by herr frau".split(),
}
AGAINST = frozenset("version release isbn issn order invoice page figure table chapter section serial model part".split())
LABELERS = ("pattern", "checksum", "gazetteer", "cue", "against", "edges", "shape", "context")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_BEFORE:
            start -= 1
        after = EMAIL_AFTER.match(text, at + 1) if start < at else None
        if after:
            yield start, after.end()
            free = after.end()
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        groups = run.group().split(".")
        start = run.start()
        for k in range(0, len(groups) - 3, 4):
            four = groups[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in four):
                yield start, start + size
            start += size + 1


def cards(text: str) -> Iterator[tuple[int, int, bool]]:
    """Digits in the number of a card, and whether their checksum holds."""
    for run in DIGITS.finditer(text):
        if run.end() - run.start() <= 37:
            digits = run.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                yield run.start(), run.end(), luhn(digits)


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in PHONE.finditer(text):
        if 9 <= sum(map(str.isdecimal, run.group())) <= 15:
            yield run.start(), run.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    found = [("email", *s) for s in emails(text)] + [("ip", *s) for s in addresses(text)]
    return found + [("card", a, b) for a, b, good in cards(text) if good] + [("phone", *s) for s in phones(text)]


def proposed_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the looser patterns propose and that no base span overlaps."""
    found = [("card", a, b) for a, b, good in cards(text) if not good]
    for at in SPELLED.finditer(text):
        before = SPELLED_BEFORE.search(text, max(0, at.start() - 65), at.start())
        after = SPELLED_AFTER.match(text, at.end())
        if before and after:
            found.append(("email_spelled", before.start(), after.end()))
    for kind, pattern in (("phone_local", LOCAL_PHONE), ("national_id", NATIONAL), ("iban", IBAN)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    found += [("person", m.start(), FAMILY.match(text, m.end()).end()) for m in GIVEN.finditer(text) if m.group() in GIVEN_NAMES]
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    free = lambda a, b: not (k := np.searchsorted(starts, b)) or reach[k - 1] <= a
    return [s for s in found if free(s[1], s[2])]


def before(text: str, start: int) -> list[str]:
    return re.findall(r"[\w-]+", text[max(0, start - 48) : start].lower())[-5:]


def votes(text: str, kind: str, start: int, end: int, is_base: bool) -> list[int]:
    """A vote of each labeler: 1 yes, 0 no, 2 none."""
    span, words = text[start:end], before(text, start)
    digits = re.sub(r"\D", "", span)
    checks = {"card": lambda: luhn(digits), "iban": lambda: int("".join(str(int(c, 36)) for c in span[4:] + span[:4])) % 97 == 1, "ip": lambda: True}
    gazetteers = {
        "email": lambda: span.rpartition(".")[2].lower() in TOP_DOMAINS,
        "email_spelled": lambda: re.split(r"\W+", span)[-1].lower() in TOP_DOMAINS,
        "person": lambda: span.split()[0] in GIVEN_NAMES,
        "phone_local": lambda: digits[0] not in "01" and digits[3] not in "01",
        "national_id": lambda: digits[:3] not in ("000", "666") and digits[0] != "9",
    }
    edges = not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum())
    plain = len(set(digits)) > 2 if digits else any(map(str.isalpha, span))
    return [
        int(is_base) if is_base or kind in BASE_KINDS else 2,
        int(checks[kind]()) if kind in checks else 2,
        int(gazetteers[kind]()) if kind in gazetteers else 2,
        1 if any(w in CUES[kind] for w in words) else 2,
        0 if any(w in AGAINST for w in words) else 2,
        int(edges),
        2 if plain else 0,
        0 if kind == "person" and (not words or start == 0 or text[start - 2 : start - 1] in ".!?\n") else 2,
    ]


def features(text: str, kind: str, start: int, end: int, voted: list[int]) -> list[int]:
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", text[start:end]))))
    after = re.findall(r"[\w-]+", text[end : end + 32].lower())[:2]
    names = [f"kind {kind}", f"shape {kind} {shape}"]
    names += [f"{labeler} {vote}" for labeler, vote in zip(LABELERS, voted)] + [f"{kind} {labeler} {vote}" for labeler, vote in zip(LABELERS, voted)]
    names += [f"before {w}" for w in before(text, start)[-3:]] + [f"after {w}" for w in after]
    return [zlib.crc32(n.encode()) % SLOTS for n in names]


SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]
)
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean, votes: string, features: array<int>>>"


def voted_spans(text: str) -> list[dict]:
    base = base_spans(text)
    rows = []
    for is_base, spans in ((True, base), (False, proposed_spans(text, base))):
        for kind, start, end in spans:
            voted = votes(text, kind, start, end, is_base)
            row = {"kind": kind, "start": start, "end": end, "base": is_base, "votes": "".join(map(str, voted))}
            rows.append(row | {"features": features(text, kind, start, end, voted)})
    return rows


def find_spans(text: str | Column) -> Column:
    """All base and proposed spans of each text, with votes and features."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([voted_spans(t) for part in pieces(texts) for t in part.to_pylist()], pa.list_(SPAN))

    return F.arrow_udf(run, SPANS)(text_or_empty(text))


def estimate(patterns: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Probability that a span is personal, for each (kind, vote pattern, number of spans).  Expectation-maximisation with labelers
    that are independent given the truth.  No vote says nothing; a labeler's chances of a yes for true and for false spans, and a
    kind's share of true spans, start from a belief in the labelers that is worth a few spans."""
    if not patterns:
        return {}
    kinds = sorted({kind for kind, _, _ in patterns})
    kind = np.array([kinds.index(p[0]) for p in patterns])
    ballots = np.array([[int(v) for v in p[1]] for p in patterns])
    count = np.array([p[2] for p in patterns], float)
    yes, no = (ballots == 1).astype(float), (ballots == 0).astype(float)
    belief = (yes.sum(axis=1) + 0.5) / (yes.sum(axis=1) + 2 * no.sum(axis=1) + 1)  # a majority, in which a no weighs more
    for _ in range(rounds):
        odds = np.zeros(len(patterns))
        for sign, share, prior_yes, prior_no in ((1, belief, 9, 1), (-1, 1 - belief, 3, 7)):
            weight = count * share
            chance = (weight @ yes + prior_yes) / (weight @ yes + weight @ no + prior_yes + prior_no)
            odds += sign * (yes @ np.log(chance) + no @ np.log(1 - chance) + np.log(np.bincount(kind, weight, len(kinds)) + 2)[kind])
        belief = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return {(p[0], p[1]): float(b) for p, b in zip(patterns, belief)}


@dataclass
class SpanClassifier:
    weights: np.ndarray

    def probability(self, slots: list[int]) -> float:
        return 1 / (1 + np.exp(-np.clip(self.weights[slots].sum(), -50, 50)))


def train(spans: list[tuple[list[int], float]], rounds: int = 200, penalty: float = 1e-4) -> SpanClassifier:
    """Logistic weights for soft labels, by gradient steps scaled to each slot."""
    weights, squares = np.zeros(SLOTS), np.full(SLOTS, 1e-8)
    if spans:
        owner = np.repeat(np.arange(len(spans)), [len(s) for s, _ in spans])
        slots, wanted = np.concatenate([s for s, _ in spans]).astype(np.int64), np.array([w for _, w in spans])
        for _ in range(rounds):
            score = np.bincount(owner, weights[slots], len(spans))
            error = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - wanted
            gradient = np.bincount(slots, error[owner], SLOTS) / len(spans) + penalty * weights
            squares += gradient**2
            weights -= 0.3 * gradient / np.sqrt(squares)
    return SpanClassifier(weights)


def fit(found: DataFrame, fit_spans: int = FIT_SPANS) -> SpanClassifier:
    """``found`` has a column ``spans``.  The classifier sees at most ``fit_spans`` spans, by a hash of place and features."""
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    counted = each.groupBy("kind", "votes").count().collect()
    likely = estimate(sorted((r["kind"], r["votes"], r["count"]) for r in counted))
    order = F.xxhash64("row", "start", "kind")
    total = sum(r["count"] for r in counted)
    if total > 2 * fit_spans:  # about twice the sample passes, so no task sends more than its share of that
        each = each.filter(order < int(2 * fit_spans / total * 2.0**64) - (1 << 63))
    sample = each.withColumn("order", order).orderBy("order", "row", "start", "kind").limit(fit_spans).select("kind", "votes", "features").collect()
    return train([(r["features"], likely[r["kind"], r["votes"]]) for r in sample])


def decide(spans: list[dict], classifier: SpanClassifier, least: float) -> list[dict]:
    """Base spans and the added ones, by kind as listed, then start."""
    chosen = [s for s in spans if s["base"]]
    likely = [(classifier.probability(s["features"]), s) for s in spans if not s["base"]]
    occupied: list[tuple[int, int]] = []
    for chance, span in sorted(likely, key=lambda x: (-x[0], x[1]["start"], -x[1]["end"], x[1]["kind"])):
        at = bisect(occupied, (span["start"], span["end"]))  # those taken do not overlap, so only the two beside can
        free = (at == 0 or occupied[at - 1][1] <= span["start"]) and (at == len(occupied) or span["end"] <= occupied[at][0])
        if chance >= least and free:
            occupied.insert(at, (span["start"], span["end"]))
            chosen.append(span)
    return sorted(chosen, key=lambda s: (KINDS.index(s["kind"]), s["start"]))


def decided(spans: Column, classifier: SpanClassifier, spark, least: float = LEAST) -> Column:
    """The spans that stay: array of kind, start, end (characters, end exclusive) and base."""
    shared = spark.sparkContext.broadcast(classifier)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([[{k: s[k] for k in ("kind", "start", "end", "base")} for s in decide(v or [], shared.value, least)] for v in lists.to_pylist()], kind)

    return F.arrow_udf(run, "array<struct<kind: string, start: int, end: int, base: boolean>>")(spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", storage: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id and its spans.  The spans found are kept in ``storage``, by default a folder below
    ``spark.checkpoint.dir``, as both the fit and the decisions read them."""
    spark = docs.sparkSession
    folder = f"{storage or scratch_path(spark, 'pii')}/found"
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), find_spans(text_col).alias("spans"))
    rows.write.parquet(folder)
    found = spark.read.parquet(folder)
    return found.select("doc_id", decided(F.col("spans"), fit(found), spark).alias("spans"))
