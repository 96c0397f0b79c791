"""Chat formatting by columnar byte assembly.

A turn is written as ``<|turn|>role<|text|>text<|end|>`` and a line feed.  Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\\|``, so no control string can stand there and the original comes back by dropping one backslash of each
pair.  For an Arrow batch the lengths of all segments give offsets by a running sum, and scatter indices copy headers
and contents into one buffer, which is the data buffer of the result.

Rows are dealt out by ranges of (conversation, turn, role, beginning of the text), not by conversation, so that a conversation
with a third of all rows is formatted by many tasks, also when its turns are null or repeated.  The ranges follow the order inside
them, so a conversation comes out as blocks in order, each of whole turns.  ``read_back``
goes over the blocks of a conversation in order and keeps running digests only, never a whole conversation.

Defined cases: null role and text count as empty; a null turn comes before all others; rows with the same turn are
ordered by role and text, and repeated rows are all formatted; a null conversation id is a conversation; roles other than
assistant are not under the loss mask; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.columns import text_or_empty

TURN, TEXT, END = b"<|turn|>", b"<|text|>", b"<|end|>\n"
TURN_FORM = re.compile(rb"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)
ESCAPED = re.compile(rb"\\(.)", re.DOTALL)
#: Characters of a text that take part in dealing out rows; the driver holds a sample of these keys.  A leading part never contradicts
#: the order of whole texts; rows that are equal up to it go to one task, which sorts them by the whole.
DEALT_CHARS = 200
#: Bytes of formatted text after which a block ends (at the end of a turn).
BLOCK_BYTES = 4 << 20
BLOCKS = "conv_id bigint, task int, block bigint, n_turns bigint, formatted string, loss_spans array<struct<start: int, end: int>>"


def escape(values: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(values, "\\", "\\\\"), "<|", "<\\|")


def unescape(data: bytes) -> bytes:
    return ESCAPED.sub(rb"\1", data)


def contents(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a text array."""
    values = pa.concat_arrays([values.cast(pa.large_string())])
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer; where each turn ends, and where its text begins and ends."""
    segments = [TURN, contents(escape(roles)), TEXT, contents(escape(texts)), END]
    n = len(roles)
    lengths = np.stack([np.full(n, len(s)) if isinstance(s, bytes) else s[2] for s in segments], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    buffer = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, segment in enumerate(segments):
        if isinstance(segment, bytes):
            buffer[starts[:, k, None] + np.arange(len(segment))] = np.frombuffer(segment, np.uint8)
        else:
            data, source, sizes = segment
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            buffer[np.repeat(starts[:, k], sizes) + within] = data[np.repeat(source, sizes) + within]
    return buffer, ends[:, -1], starts[:, 3], ends[:, 3]


def format_batch(batch: pa.RecordBatch, first_block: int, task: int) -> pa.RecordBatch:
    """Blocks of the turns of a batch; one ends where the conversation changes or enough bytes are written."""
    buffer, ends, text_starts, text_ends = assemble(batch.column("role"), batch.column("text"))
    ids = batch.column("conv_id")
    known, values = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    changes = (values[1:] != values[:-1]) | (known[1:] != known[:-1]) | (ends[1:] // BLOCK_BYTES != ends[:-1] // BLOCK_BYTES)
    firsts = np.concatenate(([0], np.flatnonzero(changes) + 1))
    lasts = np.concatenate((firsts[1:], [len(values)]))
    offsets = np.concatenate(([0], ends[lasts - 1]))
    formatted = pa.Array.from_buffers(pa.large_string(), len(firsts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)])
    masked = pc.equal(batch.column("role"), "assistant").to_numpy(zero_copy_only=False)
    block_of = np.repeat(np.arange(len(firsts)), lasts - firsts)
    spans = pa.StructArray.from_arrays(
        [pa.array((at - offsets[block_of])[masked].astype(np.int32)) for at in (text_starts, text_ends)], ["start", "end"]
    )
    span_ends = np.concatenate(([0], np.cumsum(masked)[lasts - 1]))
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(firsts)),
            pa.array(np.full(len(firsts), task, np.int32)),
            pa.array(first_block + np.arange(len(firsts))),
            pa.array(lasts - firsts),
            formatted.cast(pa.string()),
            pa.ListArray.from_arrays(pa.array(span_ends, pa.int32()), spans),
        ],
        ["conv_id", "task", "block", "n_turns", "formatted", "loss_spans"],
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Blocks of formatted turns: conv_id, task and block (their order), n_turns, formatted, loss_spans (bytes of ``formatted``
    that hold assistant text)."""
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        text_or_empty("role").alias("role"),
        text_or_empty("text").alias("text"),
    )
    keys = ["conv_id", "turn", "role", F.substring("text", 1, DEALT_CHARS)]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            step = max(1, batch.num_rows * 2 * BLOCK_BYTES // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, step):
                made = format_batch(batch.slice(start, step), block, task)
                block += made.num_rows
                yield made

    return rows.drop("turn").mapInArrow(run, BLOCKS)


def read_back(blocks: DataFrame) -> DataFrame:
    """One row per conversation, read from the formatted text: n_turns, digests of its turns and of the text under the loss
    mask, and its size."""

    class Reader:
        def __init__(self) -> None:
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
            self.n_turns = self.loss_chars = self.chars = 0

        def take(self, formatted: str, spans: list[dict]) -> None:
            data = formatted.encode()
            self.chars += len(formatted)
            for role, text in TURN_FORM.findall(data):
                self.n_turns += 1
                self.turns.update(b"%s\n%s\n" % (unescape(role), unescape(text)))
            for span in spans:
                text = unescape(data[span["start"] : span["end"]])
                self.loss.update(text)
                self.loss_chars += len(text.decode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        at, reader = None, None
        for batch in batches:
            done = []
            for conv_id, formatted, spans in zip(*(batch.column(c) for c in ("conv_id", "formatted", "loss_spans"))):
                key = (conv_id.as_py(),)
                if key != at:
                    if reader:
                        done.append((*at, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
                    at, reader = key, Reader()
                reader.take(formatted.as_py(), spans.as_py())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in done], schema)
        if reader:
            row = (*at, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars)
            yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)

    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "task", "block").select("conv_id", "formatted", "loss_spans")
    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
