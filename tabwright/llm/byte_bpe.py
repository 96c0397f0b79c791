"""Byte-level BPE: encoding, offsets and decoding over Arrow batches.

A rank file gives the byte strings of the vocabulary.  The tokenizers library merges them; every pair of shorter tokens that
makes a token is a merge, in the order of the ranks, and a piece that is a token is taken whole.  A text is cut at
white space into units first.  A unit always begins where a piece of the split pattern begins, so its ids do not depend on
its neighbours, and each distinct unit is encoded once while it is in the worker's store.

Defined cases: null and empty texts have no ids; equal texts have equal ids; the texts of other columns are never read.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tabwright.llm.columns import PIECE_BYTES, pieces, text_or_empty

#: Units in a worker's store; when it is full it becomes the older store, and what is found there moves on.  Results do not
#: depend on it.
STORE_UNITS = 200_000
#: Bytes of an id that is not in the vocabulary: the replacement character.
UNKNOWN = "\ufffd".encode()
#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of Latin-1, by ranges.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
WORD = re.compile(f" ?[{LETTERS}]+")
WORDS_AT_ONCE = 1000
#: Latin letters before white space, an end or common marks, else anything up to white space, else white space.
UNIT = re.compile(
    f" ?[{LETTERS}]+(?![^{WHITE_SPACE}.,;:!?|#$%&*()-])"
    f"| ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]"
)


def byte_alphabet() -> list[str]:
    """A visible character for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [33 <= b <= 126 or 161 <= b <= 255 and b != 173 for b in range(256)]
    moved = iter(range(256, 512))
    return [chr(b) if own[b] else chr(next(moved)) for b in range(256)]


class ByteBPE:
    """The tokenizer of one rank file, with its byte table."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        alphabet = byte_alphabet()
        seen = {token: "".join(alphabet[b] for b in token) for token in ranks}
        merges = [
            (seen[token[:k]], seen[token[k:]])
            for token, rank in sorted(ranks.items(), key=lambda item: item[1])
            for k in range(1, len(token))
            if ranks.get(token[:k], rank) < rank and ranks.get(token[k:], rank) < rank
        ]
        model = models.BPE(vocab={seen[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.merger = Tokenizer(model)  # for words that are one piece, as the byte table writes them
        self.seen = str.maketrans({chr(b): c for b, c in enumerate(alphabet)})
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.token_bytes = [UNKNOWN] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = bytes(byte_of[c] for c in seen[token])
        self.token_bytes.append(UNKNOWN)
        self.token_sizes = np.array([len(t) for t in self.token_bytes], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.table = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as int32 bytes."""
        units = [UNIT.findall(text) for text in texts]
        store = self.store
        missing = {u for found in units for u in found if u not in store}
        if missing:
            if len(store) + len(missing) > STORE_UNITS:
                self.older, self.store = store, {}
                store, missing = self.store, {u for found in units for u in found}
            older = self.older
            for unit in [u for u in missing if u in older]:
                store[unit] = older[unit]
                missing.discard(unit)
            words = [u for u in missing if WORD.fullmatch(u)]
            self.encode_words(words)
            rest = list(missing.difference(words))
            for unit, encoded in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
                store[unit] = np.array(encoded.ids, "<i4").tobytes()
        return [b"".join(map(store.__getitem__, found)) for found in units]

    def forget(self) -> None:
        """Empty the stores: an idle worker keeps its memory."""
        self.store, self.older = {}, {}

    def encode_words(self, words: list[str]) -> None:
        """Store the ids of words that the split pattern leaves whole; one call of the library for many."""
        bytewise = "\0".join(words).encode().decode("latin-1").split("\0") if words else []
        groups = [[w.translate(self.seen) for w in bytewise[k : k + WORDS_AT_ONCE]] for k in range(0, len(words), WORDS_AT_ONCE)]
        for k, encoded in enumerate(self.merger.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)):
            data = np.array(encoded.ids, "<i4").tobytes()
            ends = [*(4 * (np.flatnonzero(np.diff(encoded.word_ids)) + 1)).tolist(), len(data)]
            for word, start, end in zip(words[k * WORDS_AT_ONCE :], [0, *ends], ends):
                self.store[word] = data[start:end]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, one after the other, and where each token ends."""
        unknown = len(self.token_bytes) - 1
        ids = np.where((ids < 0) | (ids > unknown), unknown, ids)
        sizes = self.token_sizes[ids]
        ends = np.cumsum(sizes)
        return self.table[np.repeat(self.token_starts[ids] - (ends - sizes), sizes) + np.arange(sizes.sum())], ends

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end character of each token.  A token that holds a part of a character covers all of it."""
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.token_sizes[ids])
        return character[ends - self.token_sizes[ids]], character[ends - 1] + 1


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def id_lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def encode(text: str | Column, path: str, pattern: str) -> Column:
    """Ids of each text (array of int), without special tokens."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path, pattern)
        for texts in batches:
            yield joined([id_lists(bpe.encode(part.to_pylist())) for part in pieces(texts)], pa.list_(pa.int32()))
        bpe.forget()

    return F.arrow_udf(run, "array<int>")(text_or_empty(text))


def encode_and_decode(text: str | Column, path: str, pattern: str) -> Column:
    """Struct of ``ids`` as by ``encode`` and ``decoded``, the bytes that they give again: one worker a task does both."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path, pattern)
        for texts in batches:
            lists, decoded = [], []
            for part in pieces(texts):
                ids = id_lists(bpe.encode(part.to_pylist()))
                data, token_ends = bpe.decode(ids.values.to_numpy())
                byte_ends = np.concatenate(([0], token_ends))[ids.offsets.to_numpy()].astype("<i4")
                lists.append(ids)
                decoded.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(byte_ends), pa.py_buffer(data)]))
            yield pa.StructArray.from_arrays([joined(lists, pa.list_(pa.int32())), joined(decoded, pa.binary())], ["ids", "decoded"])
        bpe.forget()

    return F.arrow_udf(run, "struct<ids: array<int>, decoded: binary>")(text_or_empty(text))


def encode_with_offsets(text: str | Column, path: str, pattern: str) -> Column:
    """Struct of three arrays of int: ``ids``, and ``starts`` and ``ends`` of each token in characters of the text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path, pattern)
        for texts in batches:
            parts: tuple[list, list, list] = ([], [], [])
            for part in pieces(texts):
                for value, ids in zip(part.to_pylist(), bpe.encode(part.to_pylist())):
                    starts, ends = bpe.offsets(value, np.frombuffer(ids, "<i4"))
                    for target, numbers in zip(parts, (ids, starts.astype("<i4").tobytes(), ends.astype("<i4").tobytes())):
                        target.append(numbers)
            yield pa.StructArray.from_arrays([id_lists(p) for p in parts], ["ids", "starts", "ends"])

    return F.arrow_udf(run, "struct<ids: array<int>, starts: array<int>, ends: array<int>>")(text_or_empty(text))


def decode(ids: str | Column, path: str, pattern: str) -> Column:
    """Bytes of each id list.  Null lists and null ids give no bytes; an unknown id gives the replacement character.  A character
    that is split over tokens is whole again, as bytes are joined before anything reads them as text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path, pattern)
        for lists in batches:
            step = max(1, len(lists) * PIECE_BYTES // max(1, lists.nbytes))
            parts = []
            for start in range(0, len(lists), step):
                part = lists.slice(start, step)
                if part.values.null_count or part.null_count:
                    part = pa.array([[i for i in value or [] if i is not None] for value in part.to_pylist()], pa.list_(pa.int32()))
                ends = part.offsets.to_numpy()
                data, token_ends = bpe.decode(part.values.to_numpy()[ends[0] : ends[-1]])
                byte_ends = np.concatenate(([0], token_ends))[ends - ends[0]].astype("<i4")
                parts.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(byte_ends), pa.py_buffer(data)]))
            yield joined(parts, pa.binary())

    return F.arrow_udf(run, "binary")(F.col(ids) if isinstance(ids, str) else ids)


def decode_text(ids: str | Column, path: str, pattern: str) -> Column:
    """Text of each id list; bytes that are no whole character, as at a cut, become the replacement character."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for data in batches:
            yield pa.array([(v or b"").decode("utf-8", "replace") for v in data.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(decode(ids, path, pattern))
