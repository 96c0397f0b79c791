"""Secrets in texts, with Spark's functions only.

Three patterns give the base spans.  Further candidates are runs of 20 characters or more of the kinds that keys and tokens are made of.
A window of 20 characters slides over a candidate, in time that grows with its length; the number of each character in it
changes by one in and one out, and so does the sum of n log2 n that gives the window's Shannon entropy.  The largest entropy is held against the limit of the
candidate's character class (hexadecimal, letters and digits, or with marks).  An allow-list suppresses candidates that only look
like secrets.  Base spans are never suppressed.

Matches have no positions in Spark; the lengths of the matches and of the parts between them give positions by running sums.
All expressions stay within the row, and nothing is shuffled.

Defined cases: a null or empty text has no spans; a candidate that touches a base span is not added; repeated rows each have
their own result.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.columns import text_or_empty

# The base patterns.  Runs below the least length are left out by the pattern itself where it can say so.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")

WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
#: Character classes in the order they are tried: name, pattern of the whole candidate, least entropy of its best window in bits.
CLASSES = (("hex", "[0-9A-Fa-f]+", 2.8), ("letters and digits", "[A-Za-z0-9]+", 3.5), ("with marks", ".+", 3.7))
#: Candidates that are suppressed: numbers, dates and rulers; universally unique identifiers; counted-up and example values.
ALLOWED = (
    r"\A[0-9+/_=-]+\z",
    r"\A[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z",
    "(?i)0123456789|abcdefgh|example|placeholder|xxxx|your[_-]?key",
)
#: Words and names made of words have no digit; these changes of case inside a word make a candidate none of them.
NO_WORD = "[0-9]|[a-z][A-Z]"
BLOCK = 256
#: Characters of a candidate that are gone over at once; counts of characters in a word of 60 bits, and the bits of one.
PIECE, PER_WORD, BITS = 1024, 12, 5


def running_sum(values: Column) -> Column:
    """Sums of the first 1, 2, ... values; in blocks, so that long arrays are not copied for each value."""

    def simple(array: Column) -> Column:
        add = lambda sums, value: F.concat(sums, F.array(F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0)) + value))
        return F.aggregate(array, F.array().cast("array<int>"), add)

    blocks = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(BLOCK)), lambda at: simple(F.slice(values, at, BLOCK)))
    before = simple(F.concat(F.array(F.lit(0)), F.transform(blocks, lambda b: F.get(b, F.size(b) - 1))))
    return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda block, base: F.transform(block, lambda x: x + base)))


def placed(text: Column, pattern: str, matched: Column) -> Column:
    """Start, end and text of each match; ``matched`` holds the texts of all matches of ``pattern``."""
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(between, 1, F.size(matched)), matched, lambda gap, m: F.char_length(gap) + F.char_length(m))
    spans = F.zip_with(matched, running_sum(lengths), lambda m, end: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("text")))
    nothing = F.array().cast("array<struct<start: int, end: int, text: string>>")
    return F.when(F.size(matched) > 0, spans).otherwise(nothing)


def best_entropy(candidate: Column) -> Column:
    """Entropy in bits of the window of ``candidate`` that has most.

    A candidate is gone over in pieces that overlap by a window less one character, so each window is in one of them."""
    pieces = F.regexp_extract_all(candidate, F.lit(f"(?=(.{{1,{PIECE + WINDOW - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    return F.array_max(F.transform(pieces, best_in_piece))


def best_in_piece(piece: Column) -> Column:
    """Counts go with the window: 5 bits for each character of the alphabet, 12 in a word.  A step changes the count of the character that
    enters and of the one that leaves, and the sum of n log2 n by their terms."""
    terms = F.array(*(F.lit(n * log2(n) if n else 0.0) for n in range(WINDOW + 2)))
    codes = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    lagging = F.concat(F.array_repeat(F.lit(-1), WINDOW), codes)
    steps = F.zip_with(codes, F.slice(lagging, 1, F.size(codes)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
    one = F.lit(1).cast("long")
    names = [f"w{k}" for k in range(-(-len(ALPHABET) // PER_WORD))]
    word = lambda code: F.floor(code / PER_WORD)
    shift = lambda code: (code % PER_WORD * BITS).cast("int")

    def count(words: Column, code: Column) -> Column:
        held = F.lit(None).cast("long")
        for k, name in reversed(list(enumerate(names))):
            held = F.when(word(code) == k, words[name]).otherwise(held)
        return F.call_function("shiftright", held, shift(code)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def changed(words: Column, code: Column, by: int) -> Column:
        step = F.call_function("shiftleft", one, shift(code)) * by
        return F.struct(*(F.when(word(code) == k, words[name] + step).otherwise(words[name]).alias(name) for k, name in enumerate(names)))

    def onward(state: Column, step: Column) -> Column:
        n = count(state.words, step.enters)
        grown = F.struct(changed(state.words, step.enters, 1).alias("words"), (state.total + F.get(terms, n + 1) - F.get(terms, n)).alias("total"))

        def left(now: Column) -> Column:
            m = count(now.words, step.leaves)
            gone = F.struct(changed(now.words, step.leaves, -1).alias("words"), (now.total + F.get(terms, m - 1) - F.get(terms, m)).alias("total"))
            return F.when(step.leaves >= 0, gone).otherwise(now)

        moved = F.get(F.transform(F.transform(F.array(grown), left), lambda now: F.struct(
            now.words.alias("words"), now.total.alias("total"), (state.at + 1).alias("at"),
            F.greatest(state.best, F.when(state.at + 1 >= WINDOW, F.lit(log2(WINDOW)) - now.total / WINDOW).otherwise(0.0)).alias("best"),
        )), F.lit(0))
        return moved

    nothing = F.struct(*(F.lit(0).cast("long").alias(name) for name in names))
    start = F.struct(nothing.alias("words"), F.lit(0.0).alias("total"), F.lit(0).alias("at"), F.lit(0.0).alias("best"))
    return F.aggregate(steps, start, onward, lambda state: state.best)


def is_secret(candidate: Column) -> Column:
    limit = F.lit(None).cast("double")
    for _, pattern, least in reversed(CLASSES):
        limit = F.when(candidate.rlike(rf"\A{pattern}\z"), F.lit(least)).otherwise(limit)
    allowed = ~candidate.rlike(NO_WORD)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(best_entropy(candidate) >= limit)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of start, place of the kind in the list, end (characters, end
    exclusive), kind; kinds assign, access, hex, entropy; ordered by start, then kind."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    every = lambda pattern, group=0: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    found = rows.select(
        "doc_id",
        "text",
        every(ASSIGN).alias("assign"),
        F.when(F.contains("text", F.lit("AKIA")), every(ACCESS)).otherwise(F.array().cast("array<string>")).alias("access"),
        every(HEX).alias("hex"),
        every(CANDIDATE).alias("candidate"),
    ).withColumn("value", F.when(F.size("assign") > 0, every(ASSIGN, 2)).otherwise(F.array().cast("array<string>")))
    kept = F.filter(F.arrays_zip(placed(F.col("text"), ASSIGN, F.col("assign")).alias("span"), "value"), lambda x: F.char_length(x.value) >= ASSIGN_LEAST)
    kind = lambda spans, name, place: F.transform(
        spans, lambda s: F.struct(s.start.alias("start"), F.lit(place).alias("place"), s.end.alias("end"), F.lit(name).alias("kind"))
    )
    based = found.select(
        "doc_id",
        F.concat(
            kind(F.transform(kept, lambda x: x["span"]), "assign", 0),
            kind(placed(F.col("text"), ACCESS, F.col("access")), "access", 1),
            kind(placed(F.col("text"), HEX, F.col("hex")), "hex", 2),
        ).alias("base"),
        placed(F.col("text"), CANDIDATE, F.col("candidate")).alias("candidates"),
    )
    touches = lambda s: F.exists("base", lambda b: (b.start < s.end) & (s.start < b.end))
    added = F.filter("candidates", lambda s: F.when(touches(s), F.lit(False)).otherwise(is_secret(s.text)))
    return based.select("doc_id", F.array_sort(F.concat("base", kind(added, "entropy", 3))).alias("spans"))
