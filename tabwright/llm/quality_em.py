"""Quality by weak labels.

Heuristic labelers look at a text with Spark's functions and say sound, faulty or nothing.  Expectation-maximisation over the counts of
vote patterns (at most 3^8 rows, whatever the size of the table) estimates each labeler's accuracy and the share of good texts; no
labelled row is used.  A text's posterior is its soft label.  A bounded sample of texts with these labels trains a linear
scorer on hashed words and word shapes, which scores all texts.

Defined cases: a null or empty text has score 0 and is not kept; ties in the sample's order are broken by id and text; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.columns import pieces, text_or_empty
from tabwright.session import scratch_path

#: Texts that train the scorer, at most, and slots of its hashed features.
FIT_ROWS, SLOTS = 2000, 1 << 16
#: Share of good texts in which a labeler sees a fault, at most.
FALSE_ALARMS = 0.002
#: Texts with this score or more are kept.
LEAST = 0.5
STORE_WORDS = 200_000
TOKEN = re.compile(r"\S+")
REPEATED = re.compile(r"(.)\1+")
#: Stands in the place of a word that repeats the one before it.
AGAIN = "\x00again"


class Shapes(dict):
    """Shape of each code point, found when it is first met: 0 for digits, A for capitals of ASCII, a for all other letters."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        shape = "0" if c.isdigit() else "A" if code < 128 and c.isupper() else "a" if c.isalnum() else c
        self[code] = shape
        return shape


SHAPES = Shapes()


def labelers(text: Column) -> dict[str, Column]:
    """Votes of the heuristics on a text: 1 sound, 0 faulty, 2 none."""
    length = F.char_length(text)
    shares = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(length, F.lit(1))
    words = F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1))
    parts = F.split(text, " ")
    doubled = F.size(F.filter(F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda a, b: a.eqNullSafe(b)), lambda same: same))
    lines = F.filter(F.split(text, "\n"), lambda line: F.char_length(line) > 0)
    # a letter before a mark of noise, then the end of the word
    noisy = F.regexp_count(text, F.lit(r"[*&%$#|!]{2,}|(?<= )\|(?= )")) / words
    others = F.regexp_count(text, F.lit(r"[^\p{L}]"))
    capital = F.regexp_count(text, F.lit("[A-Z]")) / F.greatest(length - others, F.lit(1))
    repeated = 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    sound = lambda bad: F.when(bad, 0).otherwise(1)
    return {
        "letters": sound((length - others) / F.greatest(length, F.lit(1)) < 0.6),
        "noise marks": sound(noisy > 0.1),
        "capitals": sound(capital > 0.4),
        "sentences": F.when(F.regexp_count(text, F.lit(r"\p{L}[.?!](\s|$)")) > 0, 1).otherwise(2),
        "word length": sound(~(length / words).between(2, 25)),
        "repeated lines": sound(repeated > 0.3),
        "doubled words": sound(doubled / words > 0.1),
        "digits": sound(shares("[0-9]") > 0.2),
    }


@dataclass
class Accuracies:
    """What expectation-maximisation found: share of good texts, and each labeler's chances of a good vote."""

    share: float
    if_good: np.ndarray
    if_bad: np.ndarray

    def posterior(self, ballots: np.ndarray) -> np.ndarray:
        yes, no = ballots == 1, ballots == 0
        odds = np.log(self.share / (1 - self.share)) + yes @ np.log(self.if_good / self.if_bad) + no @ np.log((1 - self.if_good) / (1 - self.if_bad))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def estimate(ballots: np.ndarray, count: np.ndarray, rounds: int = 100) -> Accuracies:
    """From vote patterns and their numbers.  Each labeler looks for a fault of its own, so most faulty texts have one vote against
    many; without the bound on false alarms the two classes would be the texts with many faults and all others."""
    yes, no = (ballots == 1).astype(float), (ballots == 0).astype(float)
    belief = np.where(no.any(axis=1), 0.02, 0.98)
    for _ in range(rounds):
        found = []
        for share, (prior_yes, prior_no) in ((belief, (9, 1)), (1 - belief, (7, 3))):
            weight = count * share
            found.append((weight @ yes + prior_yes) / (weight @ yes + weight @ no + prior_yes + prior_no))
        found[0] = np.maximum(found[0], 1 - FALSE_ALARMS)
        result = Accuracies(float((count @ belief + 7) / (count.sum() + 10)), *found)
        belief = result.posterior(ballots)
    return result


def tokens_of(text: str) -> list[str]:
    """Words of a text; one that repeats the word before it counts as a repetition only."""
    words = TOKEN.findall(text)
    return words[:1] + [AGAIN if a == b else b for a, b in zip(words, words[1:])]


def token_slots(token: str) -> list[int]:
    """Slots of a word: itself, its end and its shape."""
    shape = REPEATED.sub(r"\1", token.translate(SHAPES))
    names = ("w" + token.lower(), "e" + token[-3:], "s" + shape)
    return [zlib.crc32(n.encode()) % SLOTS for n in names]


@dataclass
class HashedScorer:
    """Score of a text: the mean weight of its words' slots, and a bias."""

    weights: np.ndarray
    bias: float = 0.0
    scale: float = 20.0
    store: dict[str, float] = field(default_factory=dict, repr=False)
    older: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"store": {}, "older": {}}

    def score(self, text: str) -> float:
        tokens = tokens_of(text)
        if not tokens:
            return 0.0
        store = self.store
        missing = {t for t in tokens if t not in store}
        if missing:
            if len(store) + len(missing) > STORE_WORDS:
                self.older, self.store = store, {}
                store, missing = self.store, set(tokens)
            weights, older = self.weights, self.older
            for token in missing:
                known = older.get(token)
                if known is None:
                    a, b, c = token_slots(token)
                    known = float(weights[a] + weights[b] + weights[c])
                store[token] = known
        total = self.scale * sum(map(store.__getitem__, tokens)) / len(tokens) + self.bias
        return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def train(rows: list[tuple[str, float]], rounds: int = 80, penalty: float = 1e-6) -> HashedScorer:
    scorer = HashedScorer(np.zeros(SLOTS))
    rows = [(tokens_of(text), wanted) for text, wanted in rows if text.strip()]
    if not rows:
        return scorer
    cache: dict[str, list[int]] = {}
    columns, values, owner = [], [], []
    for i, (tokens, _) in enumerate(rows):
        slots: list[int] = []
        for token in tokens:
            found = cache.get(token)
            if found is None:
                found = cache[token] = token_slots(token)
            slots += found
        unique, count = np.unique(slots, return_counts=True)
        columns.append(unique)
        values.append(scorer.scale * count / len(tokens))
        owner.append(np.full(len(unique), i))
    column, value, owner_ = (np.concatenate(x) for x in (columns, values, owner))
    wanted = np.array([w for _, w in rows])
    squares, bias_square = np.full(SLOTS, 1e-8), 1e-8
    for _ in range(rounds):
        score = np.bincount(owner_, value * scorer.weights[column], len(rows)) + scorer.bias
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - wanted) / len(rows)
        gradient = np.bincount(column, value * error[owner_], SLOTS) + penalty * scorer.weights
        squares += gradient**2
        scorer.weights -= 0.05 * gradient / np.sqrt(squares)
        bias_square += error.sum() ** 2
        scorer.bias -= 0.05 * error.sum() / np.sqrt(bias_square)
    return scorer


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, storage: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, posterior (of the votes), score (of the scorer), kept.  Texts and their votes are kept in
    ``storage``, by default a folder below ``spark.checkpoint.dir``; both passes over the texts read this one table, so a posterior stays
    with its row whatever the ids are."""
    spark = docs.sparkSession
    folder = f"{storage or scratch_path(spark, 'quality')}/votes"
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    names = list(labelers(F.lit("")))
    order = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit("fit")), F.lit(1 << 40))
    voted = rows.select("doc_id", "text", order.alias("order"), F.concat(*(v.cast("string") for v in labelers(F.col("text")).values())).alias("votes"))
    voted.write.option("compression", "zstd").parquet(folder)
    votes = spark.read.parquet(folder)
    patterns = sorted((r["votes"], r["count"]) for r in votes.groupBy("votes").count().collect())
    if not patterns:
        return spark.createDataFrame([], "doc_id bigint, posterior double, score double, kept boolean")
    ballots = np.array([[int(v) for v in p] for p, _ in patterns]).reshape(-1, len(names))
    found = estimate(ballots, np.array([n for _, n in patterns], float))
    posterior = dict(zip((p for p, _ in patterns), map(float, found.posterior(ballots))))
    # The sample: the texts whose hashes are smallest, found among the votes first so that texts are not sorted.
    total = sum(n for _, n in patterns)
    limit = int((1 << 40) * min(1.0, 2.0 * fit_rows / total))
    near = votes.filter(F.col("order") < limit)
    keys = near.select("order", "votes").distinct().orderBy("order").limit(fit_rows).select("order")
    sample = near.join(F.broadcast(keys), "order", "left_semi").distinct().limit(2 * fit_rows).collect()
    sample = sorted(sample, key=lambda r: (r["order"], r["text"]))
    scorer = spark.sparkContext.broadcast(train([(r["text"], posterior[r["votes"]]) for r in sample]))
    table = spark.createDataFrame(list(posterior.items()), "votes string, posterior double")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([scorer.value.score(t) for part in pieces(texts) for t in part.to_pylist()], pa.float64())

    scored = votes.select("doc_id", "votes", F.arrow_udf(run, "double")("text").alias("score"))
    # at most 3^8 rows
    return scored.join(F.broadcast(table), "votes").select("doc_id", "posterior", "score", (F.col("score") >= LEAST).alias("kept"))
