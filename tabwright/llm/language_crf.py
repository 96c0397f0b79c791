"""Language of each word of a text by a linear-chain conditional random field.

A word's score for a language is the sum of hashed weights: of its character n-grams with marks for its two ends (so those
at an end are its affixes), of the whole word, and of its entry in a lexicon learned from the fit.  Learned transitions
tie neighbours together.  The fit chains segments of documents of different languages, as code-switched text does, and follows
the gradient of the conditional likelihood.  Forward-backward gives each word's probabilities; a document's language is the one
with the largest mean over its words, its score that mean.

All words of an Arrow batch form one chain that starts anew at each document.  It is cut into blocks; the products of the
blocks' matrices carry the exact state over their ends, so that numpy works on all blocks at once.

Defined cases: a null text or one without a letter has the language ``und`` and score 0; with equal means the first language in
order wins; rows without a language or text teach nothing; a table without any teaches no language, and every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.columns import pieces, text_or_empty

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Rows of each language that a fit reads, and slots for hashed weights.
FIT_ROWS = 300
SLOTS = 1 << 18
#: Words of a lexicon, the most frequent ones of the fit, and the share of one language that puts a word there.
LEXICON_WORDS, LEXICON_SHARE = 20_000, 0.8
LONGEST_GRAM = 4
BLOCK = 64
#: Words whose scores a worker keeps; the store is emptied when it is full.  Results do not depend on it.
STORE_WORDS = 100_000

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features and the word each belongs to, in order of the words."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    word, left = np.repeat(np.arange(len(words)), sizes), np.repeat(ends, sizes) - np.arange(len(codes))
    place = np.repeat(sizes, sizes) - left
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(mixed(codes * ODD + place.astype(np.uint64)), ends - sizes)
        slots, owners = [mixed(whole)], [np.arange(len(words))]
        gram = np.zeros(len(codes), np.uint64)
        for n in range(1, LONGEST_GRAM + 1):
            following = np.zeros_like(codes)
            following[: len(codes) - n + 1] = codes[n - 1 :]
            gram = mixed(gram * ODD + following + np.uint64(n))
            fits = left >= n
            slots.append(gram[fits])
            owners.append(word[fits])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(slots)[order] % np.uint64(SLOTS)).astype(np.int64), owner[order]


def forward_backward(scores: np.ndarray, transitions: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised forward and backward vectors and the emissions.  ``starts`` marks first words; ``transitions`` has the scores
    of a first word in its last row."""
    n, k = scores.shape
    blocks = -(-n // BLOCK)
    emission = np.ones((blocks * BLOCK, k))
    emission[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    first = np.ones(blocks * BLOCK, bool)
    first[:n] = starts
    emission, first = emission.reshape(blocks, BLOCK, k), first.reshape(blocks, BLOCK, 1)
    step, start = np.exp(transitions[:k]), np.exp(transitions[k])

    def onward(state: np.ndarray, t: int) -> np.ndarray:
        entered = np.where(first[:, t], state.sum(axis=-1, keepdims=True) * start, state @ step) * emission[:, t]
        return entered / entered.sum(axis=-1, keepdims=True)

    product = np.broadcast_to(np.eye(k), (blocks, k, k))
    for t in range(BLOCK):
        at = first[:, t][:, None]
        product = np.where(at, product.sum(axis=-1, keepdims=True) * start, product @ step) * emission[:, t][:, None]
        product = product / product.sum(axis=(1, 2), keepdims=True)
    entry, exit_ = np.empty((blocks, k)), np.empty((blocks, k))
    state = np.full(k, 1 / k)
    for b in range(blocks):
        entry[b] = state
        state = state @ product[b]
        state = state / state.sum()
    state = np.full(k, 1 / k)
    for b in range(blocks - 1, -1, -1):
        exit_[b] = state
        state = product[b] @ state
        state = state / state.sum()
    forward, backward = np.empty_like(emission), np.empty_like(emission)
    for t in range(BLOCK):
        entry = onward(entry, t)
        forward[:, t] = entry
    for t in range(BLOCK - 1, -1, -1):
        backward[:, t] = exit_
        ahead = emission[:, t] * exit_
        exit_ = np.where(first[:, t], (ahead @ start)[:, None], ahead @ step.T)
        exit_ = exit_ / exit_.sum(axis=1, keepdims=True)
    return forward.reshape(-1, k)[:n], backward.reshape(-1, k)[:n], emission.reshape(-1, k)[:n]


def marginals(scores: np.ndarray, transitions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    forward, backward, _ = forward_backward(scores, transitions, starts)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True)


@dataclass
class LanguageModel:
    """Weights of a fit; all arrays have a fixed size."""

    languages: list[str]
    weights: np.ndarray  # slot, language
    transitions: np.ndarray  # from, to; the last row is for first words
    lexicon: dict[str, int]  # word: language
    lexicon_weights: np.ndarray  # language of the entry (last: none), language
    store: dict[str, int] = field(default_factory=dict, repr=False)
    kept: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"store": {}, "kept": None}

    def forget(self) -> None:
        """Empty the store: an idle worker keeps its memory."""
        self.store.clear()
        self.kept = None

    def scores(self, words: list[str]) -> np.ndarray:
        slots, owner = word_features(words)
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        entries = [self.lexicon.get(w, -1) for w in words]
        return np.add.reduceat(self.weights[slots], begins) + self.lexicon_weights[entries]

    def look_up(self, words: list[str]) -> np.ndarray:
        """Scores of the words of a text or of many; each distinct word is scored once while it is in the store."""
        store = self.store
        missing = [w for w in dict.fromkeys(words) if w not in store]
        if missing and len(store) + len(missing) > STORE_WORDS:
            store.clear()
            self.kept, missing = None, list(dict.fromkeys(words))
        for start in range(0, len(missing), 50_000):
            part = missing[start : start + 50_000]
            base, new = len(store), self.scores(part)
            if self.kept is None or base + len(part) > len(self.kept):
                grown = np.empty((max(base + len(part), 2 * base), len(self.languages)), np.float32)
                if base:
                    grown[:base] = self.kept[:base]
                self.kept = grown
            self.kept[base : base + len(part)] = new
            store.update(zip(part, range(base, base + len(part))))
        return self.kept[[store[w] for w in words]].astype(np.float64)

    def word_probabilities(self, found: list[list[str]]) -> np.ndarray:
        """Probabilities of each word of each text, one text after the other."""
        sizes = np.array([len(words) for words in found])
        words = [w for words in found for w in words]
        if not words or not self.languages:
            return np.zeros((len(words), len(self.languages)))
        starts = np.zeros(len(words), bool)
        starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return marginals(self.look_up(words), self.transitions, starts)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        found = [split_words(text.lower()) for text in texts]
        sizes = np.array([len(words) for words in found])
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        some = np.flatnonzero(sizes)
        if len(some) and self.languages:
            shares = np.add.reduceat(self.word_probabilities(found), (np.cumsum(sizes) - sizes)[some]) / sizes[some, None]
            best = shares.argmax(axis=1)
            for row, language, share in zip(some.tolist(), best.tolist(), shares.max(axis=1).tolist()):
                names[row], scores[row] = self.languages[language], min(1.0, share)
        return names, scores


def split_words(text: str) -> list[str]:
    words = WORD.findall(text)
    return words if text.isascii() else [w for w in words if any(map(str.isalpha, w))]


def fit(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.3, seed: int = 7) -> LanguageModel:
    """A model from (language, text) rows.  Segments of 3 to 40 words are chained in random order."""
    rng = np.random.default_rng(seed)
    languages = sorted({language for language, _ in rows})
    k, index = len(languages), {language: i for i, language in enumerate(languages)}
    types: dict[str, int] = {}
    segments = []
    for language, text in rows:
        ids = np.array([types.setdefault(w, len(types)) for w in split_words(text.lower())], np.int64)
        start = 0
        while start < len(ids):
            size = int(rng.integers(3, 41))
            segments.append((ids[start : start + size], index[language]))
            start += size
    model = LanguageModel(languages, np.zeros((SLOTS, k), np.float32), np.zeros((k + 1, k)), {}, np.zeros((k + 1, k), np.float32))
    if not segments:
        return model if not languages else LanguageModel([], np.zeros((SLOTS, 0), np.float32), np.zeros((1, 0)), {}, np.zeros((1, 0), np.float32))
    counts = np.zeros((len(types), k))
    for ids, language in segments:
        np.add.at(counts, (ids, language), 1)
    words, total = list(types), counts.sum(axis=1)
    top = counts.argmax(axis=1)
    sure = np.flatnonzero((total >= 3) & (counts.max(axis=1) >= LEXICON_SHARE * total))
    sure = sure[np.lexsort((sure, -total[sure]))][:LEXICON_WORDS]
    model.lexicon = {words[i]: int(top[i]) for i in sure}
    entry = np.full(len(types), k)
    entry[sure] = top[sure]
    slots, owner = word_features(words)
    begins = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(slots))
    squares = {name: np.full(getattr(model, name).shape, 1e-6) for name in ("weights", "transitions", "lexicon_weights")}

    def descend(name: str, gradient: np.ndarray) -> None:
        squares[name] += gradient**2
        getattr(model, name)[...] -= rate * gradient / np.sqrt(squares[name])

    per_step = max(1, min(1500, len(segments) // 8))
    for _ in range(epochs):
        order = rng.permutation(len(segments))
        for at in range(0, len(order), per_step):
            chain = [segments[i] for i in order[at : at + per_step]]
            ids = np.concatenate([s[0] for s in chain])
            labels = np.repeat([s[1] for s in chain], [len(s[0]) for s in chain])
            used, local = np.unique(ids, return_inverse=True)
            sizes = begins[used + 1] - begins[used]
            own = np.repeat(begins[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            own_slots, own_word = slots[own], np.repeat(np.arange(len(used)), sizes)
            scores = np.add.reduceat(model.weights[own_slots], np.cumsum(sizes) - sizes) + model.lexicon_weights[entry[used]]
            starts = np.zeros(len(ids), bool)
            starts[0] = True
            forward, backward, emission = forward_backward(scores[local].astype(np.float64), model.transitions, starts)
            both = forward * backward
            error = both / both.sum(axis=1, keepdims=True)
            pairs = forward[:-1, :, None] * np.exp(model.transitions[:k]) * (emission[1:] * backward[1:])[:, None, :]
            moves = np.zeros((k + 1, k))
            moves[:k] = (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            moves[k] = error[0]
            np.add.at(moves, (labels[:-1], labels[1:]), -1)
            moves[k, labels[0]] -= 1
            error[np.arange(len(ids)), labels] -= 1
            by_word = np.stack([np.bincount(local, error[:, j], len(used)) for j in range(k)], axis=1)
            gradient = np.stack([np.bincount(own_slots, by_word[own_word, j], SLOTS) for j in range(k)], axis=1)
            descend("weights", gradient)
            descend("lexicon_weights", np.stack([np.bincount(entry[used], by_word[:, j], k + 1) for j in range(k)], axis=1))
            descend("transitions", moves)
    # A document without a change of language teaches first words as well as any.
    model.transitions[k] = 0
    return model


def held_out(id_column: str | Column) -> Column:
    """Whether a row is kept from every fit: crc32 of its id as text leaves 1 when divided by 3."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_sample(docs: DataFrame, rows_each: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most ``rows_each`` rows of each language, by a hash of the id.  Counts of the languages give hash limits that let about
    three times as many pass, so that no large group is sorted."""
    usable = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    ).filter(~held_out("id") & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull())
    usable = usable.withColumn("rank", F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 40)))
    # One number for each language, as many as the model has states.
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return []
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, 3.0 * rows_each * (1 << 40) / n)])
    near = usable.filter(F.col("rank") < limits[F.col("lang")])
    numbered = near.selectExpr("lang", "text", "id", "rank", "row_number() OVER (PARTITION BY lang ORDER BY rank, id, text) AS place")
    chosen = numbered.filter(F.col("place") <= rows_each).select("lang", "place", "text").collect()
    return [(r.lang, r.text) for r in sorted(chosen, key=lambda r: (r.lang, r.place))]


def fit_documents(docs: DataFrame, **options) -> LanguageModel:
    """A model from the rows of ``docs`` that are not held out; see ``fit_sample`` for its bound and options."""
    return fit(fit_sample(docs, **options))


def predict(text: str | Column, model: LanguageModel, spark) -> Column:
    """Struct of ``lang`` and ``score`` for each text."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], []
            for part in pieces(texts):
                for target, values in zip((names, scores), shared.value.predict(part.to_pylist())):
                    target.extend(values)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])
        shared.value.forget()

    return F.arrow_udf(run, "struct<lang: string, score: double>")(text_or_empty(text))


def label_words(text: str | Column, model: LanguageModel, spark) -> Column:
    """Array of ``word``, ``start`` (character), ``lang`` and ``probability`` for each text; empty without a letter."""
    shared = spark.sparkContext.broadcast(model)
    kind = "array<struct<word: string, start: int, lang: string, probability: double>>"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            rows = []
            for value in texts.to_pylist():
                words = [m for m in WORD.finditer(value) if any(map(str.isalpha, m.group()))]
                chances = own.word_probabilities([[m.group().lower() for m in words]])
                best = chances.argmax(axis=1) if own.languages else []
                rows.append(
                    [{"word": m.group(), "start": m.start(), "lang": own.languages[b], "probability": float(c[b])} for m, b, c in zip(words, best, chances)]
                )
            yield pa.array(rows, pa.list_(pa.struct([("word", pa.string()), ("start", pa.int32()), ("lang", pa.string()), ("probability", pa.float64())])))

    return F.arrow_udf(run, kind)(text_or_empty(text))
