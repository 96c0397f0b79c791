"""Exact token counts at every prefix of a text, for a sentencepiece BPE model.

The model puts a mark for a space before the text and for each space in it.  No piece of the model holds a mark after
another character or a line feed at all, so the tokens of a text are those of its chunks (marks, then other characters, or a line
feed).  Within a chunk a table runs over the prefixes: the last token of the prefix of ``i`` characters is the one piece
that ends there and that the merges keep apart from the last token of what lies before it; its count is one more
than the count there.  The table of a chunk is kept in the worker while there is room, and a text's counts are the sums over
its chunks.

``prefix_delta`` holds, for each character of the text, by how much the count changes when the prefix grows by it (one
signed byte).  Its running sum is the exact count at every prefix; cuts and budgets read it and encode nothing again.

Defined cases: null and empty texts have 0 tokens and an empty table; equal texts have equal tables.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabwright.llm.columns import pieces, text_or_empty

MARK = "▁"
CHUNK = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Chunks in a worker's store; when it is full it becomes the older store, and what is found there moves on.  Results do not
#: depend on it.
STORE_CHUNKS = 200_000


class PrefixCounter:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.vocab_size())
        special = lambda i: self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)
        self.vocabulary = {self.model.id_to_piece(i): i for i in ids if not special(i)}
        self.alone = {i for p, i in self.vocabulary.items() if self.merged(p) == [i]}
        self.backwards: dict = {}  # pieces by their characters from the last to the first; "" holds the id
        for piece, i in self.vocabulary.items():
            node = self.backwards
            for character in reversed(piece):
                node = node.setdefault(character, {})
            node[""] = i
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.vocabulary):
            raise ValueError("a piece of this model crosses the end of a chunk")

    def merged(self, characters: str) -> list[int]:
        """Tokens of ``characters`` where no mark is put before them: a line feed keeps it, and itself, away."""
        return self.model.encode("\n" + characters)[2:]

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two as two tokens."""
        if len(self.apart) > 2 * STORE_CHUNKS:
            self.apart.clear()
        known = self.merged(self.model.id_to_piece(left) + self.model.id_to_piece(right)) == [left, right]
        self.apart[left << 32 | right] = known
        return known

    def fill(self, chunks: list[str]) -> None:
        """Store the table of each chunk.  They come sorted: a chunk goes on where it leaves the one before it."""
        count, last, steps, before = [0], [-1], bytearray(), ""
        backwards, alone, apart = self.backwards, self.alone, self.apart
        for chunk in chunks:
            same = 0
            for a, b in zip(chunk, before):
                if a != b:
                    break
                same += 1
            del count[same + 1 :], last[same + 1 :], steps[same:]
            for end in range(same, len(chunk)):
                node, ending = backwards, []
                for start in range(end, -1, -1):
                    node = node.get(chunk[start])
                    if node is None:
                        break
                    if "" in node:
                        ending.append((node[""], start))
                for piece, start in reversed(ending):
                    left = last[start]
                    if left < 0:  # at the start, or after a character without a piece: nothing can merge over it
                        kept = piece in alone
                    else:
                        kept = apart.get(left << 32 | piece)
                        if kept is None:
                            kept = self.stays_apart(left, piece)
                    if kept:
                        total = count[start] + 1
                        last.append(piece)
                        break
                else:
                    total = count[end] + len(chunk[end].encode())
                    last.append(-1)
                steps.append((total - count[-1]) & 0xFF)
                count.append(total)
            self.store[chunk] = bytes(steps)
            before = chunk

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """By how much the count changes at each character, for each text."""
        store = self.store
        found = [CHUNK.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        missing = {c for chunks in found for c in chunks if c not in store}
        if missing:
            if len(store) + len(missing) > STORE_CHUNKS:
                self.older, self.store = store, {}
                store, missing = self.store, {c for chunks in found for c in chunks}
            older = self.older
            for chunk in [c for c in missing if c in older]:
                store[chunk] = older[chunk]
                missing.discard(chunk)
            self.fill(sorted(missing))
        out = []
        for chunks in found:
            steps = np.frombuffer(b"".join(map(store.__getitem__, chunks)), np.int8)
            if len(steps):
                steps, first = steps[1:].copy(), steps[0]
                steps[0] += first  # of the mark before the text
            out.append(steps)
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_prefixes(text: str | Column, path: str) -> Column:
    """Struct of ``n_tokens`` (long) and ``prefix_delta`` (binary) of each text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = load(path)
        for texts in batches:
            totals, tables = [], []
            for part in pieces(texts):
                for steps in counter.tables(part.to_pylist()):
                    totals.append(int(steps.sum(dtype=np.int64)))
                    tables.append(steps.tobytes())
            yield pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(tables, pa.binary())], ["n_tokens", "prefix_delta"])

    return F.arrow_udf(run, "struct<n_tokens: bigint, prefix_delta: binary>")(text_or_empty(text))


def tokens_of_prefix(prefix_delta: Column, characters: Column) -> Column:
    """Tokens of the first ``characters`` characters; null for a null table or number."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for tables, ends in batches:
            rows = zip(tables.to_pylist(), ends.to_pylist())
            yield pa.array([None if t is None or n is None else int(np.frombuffer(t, np.int8)[: max(n, 0)].sum(dtype=np.int64)) for t, n in rows], pa.int64())

    return F.arrow_udf(run, "bigint")(prefix_delta, characters.cast("bigint"))


def longest_prefix(prefix_delta: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens; null for a null table or budget."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for tables, budgets in batches:
            ends = []
            for table, budget in zip(tables.to_pylist(), budgets.to_pylist()):
                if table is None or budget is None:
                    ends.append(None)
                    continue
                fits = np.flatnonzero(np.frombuffer(table, np.int8).cumsum(dtype=np.int64) <= budget)
                ends.append(int(fits[-1]) + 1 if len(fits) else 0)
            yield pa.array(ends, pa.int64())

    return F.arrow_udf(run, "bigint")(prefix_delta, budget.cast("bigint"))
