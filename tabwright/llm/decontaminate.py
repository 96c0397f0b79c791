"""Benchmark decontamination by pigeonhole edit matching.

An item that stands in a text with at most ``k`` edits, cut into ``k + 1`` pieces, has a piece there that is untouched.  One
automaton finds all pieces of a block of items in one pass over a text; each hit says where the item would have to begin, give or take
``k``.  Myers' bit-parallel distance then compares the item with that stretch; a bit vector of Python's whole numbers holds
the item at any length.  Texts and items are in lower case with single spaces.

Items are sent to the executors in blocks of bounded size, one pass over the texts for each block.

Defined cases: a null or empty item matches nothing, and so does a null or empty text; equal items each match; an item
shorter than ``k + 1`` characters keeps as many pieces as characters; empty tables give an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.columns import free_name, pieces, text_or_empty

#: Edits that are allowed for each character of an item.
ERROR_RATE = 0.05
#: Bytes of items that are sent to the executors at once.
BLOCK_BYTES = 8 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def distance_within(item_bits: dict[str, int], size: int, stretch: str) -> tuple[int, int]:
    """Fewest edits between the item and a part of ``stretch``, and the first place where such a part ends."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, end = size, 0
    for i, character in enumerate(stretch):
        equal = item_bits.get(character, 0)
        cross = equal | down
        run = (((equal & up) + up) ^ up) | equal
        right, left = down | ~(run | up) & full, up & run
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1 & full, left << 1 & full
        up, down = left | ~(cross | right) & full, right & cross
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items, where = [], defaultdict(list)
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            budget = int(error_rate * len(text))
            bits: dict[str, int] = defaultdict(int)
            for i, character in enumerate(text):
                bits[character] |= 1 << i
            cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
            for start, end in zip(cuts, cuts[1:]):
                if end > start:
                    where[text[start:end]].append((len(self.items), start))
            self.items.append((item_id, text, dict(bits), budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """Item, fewest edits and place of each item that stands in ``text``; the first of several places with as few."""
        if not self.items or not text:
            return []
        begins: dict[int, set[int]] = defaultdict(set)
        for last, (size, places) in self.automaton.iter(text):
            for item, start in places:
                begins[item].add(last + 1 - size - start)
        found = []
        for item, diagonals in begins.items():
            item_id, wanted, bits, budget = self.items[item]
            best = (budget + 1, 0)
            for start, end in self.stretches(sorted(diagonals), len(wanted), budget, len(text)):
                stretch = text[start:end]
                at = stretch.find(wanted)
                edits, place = (0, at + len(wanted)) if at >= 0 else distance_within(bits, len(wanted), stretch)
                if edits < best[0]:
                    best = (edits, start + place)
            if best[0] <= budget:
                found.append((item_id, *best))
        return found

    @staticmethod
    def stretches(diagonals: list[int], size: int, budget: int, limit: int) -> Iterator[tuple[int, int]]:
        """Where the item can stand, given where it would begin without edits; stretches that overlap are one."""
        start = end = None
        for diagonal in diagonals:
            low, high = max(0, diagonal - budget), min(limit, diagonal + size + budget)
            if high - low < size - budget:
                continue
            if start is None or low > end:
                if start is not None:
                    yield start, end
                start, end = low, high
            else:
                end = max(end, high)
        if start is not None:
            yield start, end


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``block_bytes`` (or one item); the driver holds one block at a time."""
    block, size = [], 0
    for row in items.select(F.col(f"`{id_col}`").cast("bigint"), text_or_empty(text_col)).toLocalIterator():
        if block and size + 4 * len(row[1]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += 4 * len(row[1])
    if block:
        yield block


MATCHES = "array<struct<item_id: bigint, edits: int, end: int>>"


def matches(text: str | Column, items: list[tuple[int, str]], spark, error_rate: float = ERROR_RATE) -> Column:
    """For each text the items of a block that stand in it: array of item_id, fewest edits and where that place ends (characters of the
    text in lower case with single spaces)."""
    shared = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(shared.value, error_rate)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            rows = [[dict(zip(("item_id", "edits", "end"), m)) for m in matcher.find(normal(t))] for part in pieces(texts) for t in part.to_pylist()]
            yield pa.array(rows, kind)

    return F.arrow_udf(run, MATCHES)(text_or_empty(text))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = ERROR_RATE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item that stands in it: doc_id, item_id, edits, end."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    parts = [
        rows.select("doc_id", F.explode(matches("text", block, spark, error_rate)).alias("m")).select("doc_id", "m.*")
        for block in item_blocks(items, item_id_col, item_text_col, block_bytes)
    ]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "doc_id bigint, item_id bigint, edits int, end int")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` in which no item stands, with all their columns."""
    found = free_name(docs, "found")
    for block in item_blocks(items, item_id_col, item_text_col, BLOCK_BYTES):
        docs = docs.withColumn(found, F.size(matches(text_col, block, docs.sparkSession, error_rate))).filter(F.col(found) == 0).drop(found)
    return docs
