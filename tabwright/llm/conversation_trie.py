"""Prefix trie of conversations from sorted sequences, their longest common prefixes and range minima.

A conversation is the sequence of the digests of its turns (role and text).  The sequences are sorted; with the length of the
prefix that each shares with the one before, the conversations that start with a given prefix are an interval around any one of them.
Each candidate prefix finds the left and the right end of its interval on its own, by binary search in a sparse table of range minima;
no stack is needed and all candidates of a block are searched at once.  A distinct prefix is taken once, where its interval
begins.  Members, children, leaves and saved words are then sums over the interval:

* a conversation is a leaf if it shares less than its length with the next one;
* the words of the turns that it shares with the one before are saved once, so what is saved in a subtree is the sum, over its members
  but for the first, of the words from the prefix's last turn to the end of the shared part.

The sequences are sorted by ranges of (sequence, id), so many equal conversations go to many ranges.  Any run of sorted rows is a block;
only prefixes that go on beyond the ends of a block are in several blocks, and their sums are added up by a digest of the prefix.

A turn that no other conversation has at its depth ends what a conversation can share.  What follows is a chain of nodes with one member
each; they come straight from the rows, so only the shared part of a conversation, and one turn more, becomes a sequence in one row.

Defined cases: null roles and texts are empty; null turns come first, and turns of one number are ordered by a digest of role and text;
repeated rows are turns of their own; rows without a conversation id belong to no conversation and are left out; an empty table gives
no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.columns import text_or_empty
from tabwright.llm.turns import in_order, placed, range_of
from tabwright.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Prefixes over several blocks up to which their table is broadcast.
SMALL_NODES = 100_000
NOTHING = hashlib.sha256().hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
NODE = pa.schema(
    [(c, pa.int64()) for c in COLUMNS[:-1]]
    + [("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("ends", pa.list_(pa.int64()))]
)
NODE_SQL = ", ".join(f"{c} bigint" for c in COLUMNS[:-1]) + ", ends_sha256 string, key binary, parent_key binary, ends array<bigint>"
#: Rebuilt conversations take this many ids as a family, and up to this many turns of its first.
FAMILY, MOST_SHARED = 20, 3


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), digest and words of each turn."""
    known = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    rows = in_order(known, "trie-turns", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    return placed(rows, "digest", "words").withColumnRenamed("place", "depth")


def members_of(rows: DataFrame) -> DataFrame:
    """conv_id and turns (their number)."""
    return rows.groupBy("conv_id").agg(F.max("depth").cast("long").alias("turns"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation ``c`` begins with the first ``crc32(c) % 4`` turns of ``c - c % 20`` and goes on with its own turns after as many.
    Rows, and members with their number of turns (0 for those that have none left)."""
    rows = materialize(rows, "trie-rows")
    own = members_of(rows)
    heads = rows.filter((F.col("depth") <= MOST_SHARED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    wanted = own.select("conv_id", "turns", shared.alias("skipped"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = heads.groupBy("base").agg(F.max("depth").alias("there"))
    wanted = wanted.join(bases, "base", "left").withColumn("taken", F.least("skipped", F.coalesce("there", F.lit(0))).cast("long"))
    wanted = materialize(wanted.drop("there"), "trie-members")
    borrowed = wanted.select("conv_id", "base", "taken").join(heads, "base").filter("depth <= taken")
    kept = rows.join(wanted.select("conv_id", "skipped", "taken"), "conv_id").filter("depth > skipped")
    kept = kept.withColumn("depth", F.col("depth") - F.col("skipped") + F.col("taken"))
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "digest", "words"]
    members = wanted.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("turns") - F.col("skipped"))).alias("turns"))
    return borrowed.select(columns).unionByName(kept.select(columns)), members


def common(a: list, b: list) -> int:
    """Depth to which two sequences, both with the root in front, are equal."""
    n = min(len(a), len(b))
    return next((k - 1 for k in range(n) if a[k] != b[k]), n - 1)


def with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what each row shares with the one before and the one after; null at both ends of the range."""
    held: pa.RecordBatch | None = None

    def made(batch: pa.RecordBatch, before: int | None, after: int | None) -> pa.RecordBatch:
        sequences = batch.column("digests").to_pylist()
        inner = [common(a, b) for a, b in pairwise(sequences)]
        columns = [pa.array([before, *inner], pa.int64()), pa.array([*inner, after], pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "before", "after"])

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            after = common(held.column("digests")[-1].as_py(), batch.column("digests")[0].as_py())
            yield made(held, before, after)
            before = after
        held = batch
    if held is not None:
        yield made(held, before, None)


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level ``k`` holds the least of each ``2^k`` values in a row."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        last, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-step], last[step:]))
    return levels


def right_end(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Last row that starts with the first ``depth`` turns of row ``at``."""
    at = at.copy()
    for k in range(len(levels) - 1, -1, -1):
        fits = at + (1 << k) < len(levels[0])
        goes = fits & (levels[k][np.where(fits, at + 1, 0)] >= depth)
        at += goes * (1 << k)
    return at


def left_end(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First row that starts with the first ``depth`` turns of row ``at``."""
    at = at.copy()
    for k in range(len(levels) - 1, -1, -1):
        fits = at - (1 << k) >= 0
        goes = fits & (levels[k][np.where(fits, at - (1 << k) + 1, 0)] >= depth)
        at -= goes * (1 << k)
    return at


def least_between(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    k = np.log2(last - first + 1).astype(int)
    out = np.empty(len(first), np.int64)
    for level in np.unique(k):
        own = k == level
        out[own] = np.minimum(levels[level][first[own]], levels[level][last[own] - (1 << level) + 1])
    return out


def prefix_keys(digests: list[bytes], depth: int) -> list[bytes]:
    """A digest of each prefix down to ``depth``."""
    keys = [hashlib.blake2b(digests[0], digest_size=16).digest()]
    for d in range(1, depth + 1):
        keys.append(hashlib.blake2b(keys[-1] + digests[d], digest_size=16).digest())
    return keys


def block_nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Nodes of sorted rows without a gap.  Those that go on beyond an end have a key, and sums over the rows of the block only."""
    ids, turns = batch.column("conv_id").to_numpy(), batch.column("turns").to_numpy()
    before, after = batch.column("before").to_numpy(), batch.column("after").to_numpy()
    n, digests = len(ids), batch.column("digests")
    lengths = digests.value_lengths().to_numpy().astype(np.int64) - 1
    shared = before.copy()
    shared[0] = -1
    levels = sparse_table(shared)

    counts = lengths - shared  # new prefixes at each row
    base, low = np.cumsum(counts) - counts, shared + 1
    row = np.repeat(np.arange(n), counts)
    depth = np.arange(len(row)) - np.repeat(base, counts) + low[row]
    left, right = left_end(levels, row, depth), right_end(levels, row, depth)

    def node(at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return base[at] + depth - low[at]

    inner = np.flatnonzero(depth > 0)
    parent = np.full(len(row), -1)
    parent[inner] = node(left_end(levels, row[inner], depth[inner] - 1), depth[inner] - 1)
    goes_left, goes_right = (left == 0) & (before[0] >= depth), (right == n - 1) & (after[-1] >= depth)
    children = np.bincount(parent[inner], ~goes_left[inner], len(row)).astype(np.int64)
    children += (depth == lengths[row]) & (turns[row] > lengths[row])

    words = pa.concat_arrays([batch.column("words")])
    sums = np.concatenate(([0], np.cumsum(words.flatten().to_numpy())))
    starts = np.cumsum(lengths + 1) - lengths - 1
    down_to = lambda at, depth: sums[starts[at] + depth + 1] - sums[starts[at]]  # noqa: E731  words of the turns to a depth
    total = lambda values: np.concatenate(([0], np.cumsum(values)))
    to_shared = down_to(np.arange(n), np.maximum(before, 0))
    above = np.where(depth > 0, down_to(row, np.maximum(depth - 1, 0)), 0)
    until = total(to_shared)
    saved = until[right + 1] - until[left + 1] - (right - left) * above + goes_left * (to_shared[left] - above)
    leaves = total(after < lengths)

    whole = np.flatnonzero(turns == lengths)
    ended_at = node(left_end(levels, whole, lengths[whole]), lengths[whole])
    ended = np.bincount(ended_at, minlength=len(row))
    ends = [ids[left[k] : left[k] + m].tolist() if (m := ended[k]) else [] for k in range(len(row))]

    keys: list[bytes | None] = [None] * len(row)
    for side, at, deepest in ((goes_left, 0, before[0]), (goes_right, n - 1, after[-1])):
        if found := np.flatnonzero(side).tolist():
            chain = prefix_keys(digests[at].as_py(), int(deepest))
            for k in found:
                keys[k] = chain[depth[k]]
    members = least_between(sparse_table(ids), left, right)
    parent_keys = [keys[p] if p >= 0 else None for p in parent]
    columns = [
        members,
        depth,
        pa.array(members[parent], mask=(parent < 0) | np.array([k is not None for k in parent_keys])),
        right - left + 1,
        children,
        leaves[right + 1] - leaves[left],
        saved,
        [hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest() if e else NOTHING for e in ends],
        keys,
        parent_keys,
        [e if keys[k] is not None else [] for k, e in enumerate(ends)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE)], schema=NODE)


def ends_digests(ends: DataFrame) -> DataFrame:
    """key and SHA-256 of its conversation ids, ascending and joined by commas, by a running digest."""
    schema = pa.schema([("its_key", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for key, conv_id in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id"))):
                if key != at:
                    if digest:
                        done.append({"its_key": at, "ends_sha256": digest.hexdigest()})
                    at, digest = key, hashlib.sha256(str(conv_id).encode())
                else:
                    digest.update(f",{conv_id}".encode())
            yield pa.RecordBatch.from_pylist(done, schema)
        if digest:
            yield pa.RecordBatch.from_pylist([{"its_key": at, "ends_sha256": digest.hexdigest()}], schema)

    return ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "its_key binary, ends_sha256 string")


def sorted_sequences(rows: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sequences in order with what each shares with its neighbours, and the rows below them, which no other conversation has."""
    alone = rows.groupBy("depth", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("its_id")).filter("n = 1")
    ends = alone.groupBy("its_id").agg(F.min("depth").alias("last"))
    members = materialize(members.join(ends, F.col("conv_id") == F.col("its_id"), "left").drop("its_id"), "trie-ends")
    held = materialize(rows.join(members, "conv_id"), "trie-held")
    near = held.filter("last IS NULL OR depth <= last").select("conv_id", "turns", F.struct("depth", "digest", "words").alias("at"))
    root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("words"))
    every = near.unionByName(members.select("conv_id", "turns", root.alias("at")))
    joined = every.groupBy("conv_id", "turns").agg(F.array_sort(F.collect_list("at")).alias("at"))
    sequences = joined.select("conv_id", "turns", F.col("at.digest").alias("digests"), F.col("at.words").alias("words"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sequences.repartitionByRange(parts, "digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    ranged = ranged.withColumn("pos", F.monotonically_increasing_id())
    schema = "conv_id bigint, turns bigint, digests array<binary>, words array<bigint>, pos bigint, before bigint, after bigint"
    return materialize(ranged.mapInArrow(with_neighbours, schema), "trie-sequences"), held.filter("depth > last")


def range_ends(sequences: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range, what its first row shares with the range before and its last row with the range after; -1 if there is none."""
    ends = sequences.filter("before IS NULL OR after IS NULL").groupBy(range_of("pos").alias("part"))
    ends = ends.agg(F.min_by("digests", "pos").alias("first"), F.max_by("digests", "pos").alias("last"))
    order = Window.orderBy("part")  # one row a range
    differs = lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    depth = lambda a, b: F.when(differs(a, b) > 0, differs(a, b) - 2).otherwise(F.size(a) - 1)
    paired = ends.select("part", "first", "last", F.lag("last").over(order).alias("earlier"), F.lead("first").over(order).alias("later"))
    found = paired.select("part", depth("earlier", "first").alias("before"), depth("last", "later").alias("after"), F.col("earlier").isNull(), F.col("later").isNull())
    return {part: (-1 if no_earlier else before, -1 if no_later else after) for part, before, after, no_earlier, no_later in found.collect()}


def trie_nodes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.  ``rows``: conv_id, depth (from 1 without gaps), digest, words; ``members``: conv_id, turns."""
    rows = materialize(rows.select("conv_id", "depth", "digest", "words"), "trie-rebuilt")
    sequences, chains = sorted_sequences(rows, members)
    at_ends = range_ends(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pos = batch.column("pos").to_numpy()
            part = (pos >> 33).tolist()
            known = [
                pa.array([at_ends[p][side] if v is None else v for p, v in zip(part, batch.column(c).to_pylist())], pa.int64())
                for side, c in enumerate(("before", "after"))
            ]
            batch = pa.RecordBatch.from_arrays([*batch.columns[:-2], *known], batch.schema.names)
            cuts = [0, *(np.flatnonzero(np.diff(pos) != 1) + 1).tolist(), len(pos)]
            for first, last in pairwise(cuts):
                yield block_nodes(batch.slice(first, last - first))

    found = materialize(sequences.select("conv_id", "turns", "digests", "words", "pos", "before", "after").mapInArrow(run, NODE_SQL), "trie-nodes")
    parted = found.filter(F.col("key").isNotNull())
    sums = [F.sum(c).alias(c) for c in COLUMNS[3:7]]
    whole = parted.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), *sums)
    digests = ends_digests(parted.select("key", F.explode("ends").alias("conv_id")))
    whole = whole.join(digests, F.col("key") == F.col("its_key"), "left").drop("its_key").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    whole = materialize(whole, "trie-parted")
    names = whole.select(F.col("key").alias("its_key"), F.col("conv_id").alias("its_parent"))
    names = F.broadcast(names) if names.count() <= SMALL_NODES else names

    def with_parent(nodes: DataFrame) -> DataFrame:
        held = nodes.drop("parent_conv_id").join(names, F.col("parent_key") == F.col("its_key"), "left")
        return held.withColumnRenamed("its_parent", "parent_conv_id").select(*COLUMNS)

    inner = found.filter(F.col("key").isNull())
    at_end = F.when(F.col("depth") == F.col("turns"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    chained = chains.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("turns")).cast("long").alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), at_end.alias("ends_sha256"),
    )
    nodes = inner.filter(F.col("parent_key").isNull()).select(*COLUMNS)
    for more in (with_parent(inner.filter(F.col("parent_key").isNotNull())), with_parent(whole), chained):
        nodes = nodes.unionByName(more.select(*COLUMNS))
    return nodes
