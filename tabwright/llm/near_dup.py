"""Near-duplicates by BagMinHash.

The words of a text (lower case, cut at white space) give a multiset of shingles of five words.  Each shingle owns Poisson processes
over time, one for each dyadic interval of its weight axis ((0, 1], (1, 2], (2, 4], ...); a point carries a component of the
signature and a cell of the interval, and counts for a text if the cell lies below the shingle's number there.  A component
keeps the earliest point that reaches it.  Two texts share it with exactly their weighted Jaccard similarity as probability.
Points are made in order of time and only up to a limit at which all components are taken.

Bands of components are candidate buckets.  Texts with equal words are one node from the start.  In each bucket every node
is compared with one hub, so a bucket of n nodes gives n pairs; links give classes, and links of later passes join them.  A bucket whose nodes are then in several
classes is gone over with another hub.  What is left open is settled without pairs of a whole bucket: two texts that are similar
enough share one of their rarest shingles, those that come first in a common order and weigh just more than the texts may
differ by, and what follows the first one they share is heavy enough in both.  The nodes outside the main class of their
bucket have pairs with the open nodes of other classes with which they share such a shingle.  A few members of each class are
compared first, then eight times as many, and so on to the last; what a pass joins needs no other pair.  All pairs of classes
that are still apart have their turn, so no pair that could join two classes is left out.  A comparison looks at the signatures first (more than six
standard deviations below the threshold is out), then at the whole multisets.

Defined cases: a text of one to four words is one shingle; a null text, or one without a word, is in a class of its own; an
empty table gives an empty result; rows with the same id keep their own classes; a class is named by its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.columns import free_name, pieces, text_or_empty
from tabwright.session import scratch_path

WORDS = 5
THRESHOLD = 0.8
#: Bands of the signature and components in a band: at a similarity of 0.8 a pair is missed with a chance of 3e-6.
BANDS, ROWS = 42, 6
COMPONENTS = BANDS * ROWS
#: Rows of a table of nodes that may be sent to all executors (about 50 bytes each); beyond it the join shuffles.
SENT_ROWS = 200_000
#: The same for labels, which several joins of each pass send: the driver makes each of these tables in its heap.
SENT_LABELS = 50_000
#: Links of classes that one task puts together (16 bytes each); beyond it labels go over them in rounds.
ONE_TASK_LINKS = 200_000
#: Passes with hubs before the rest is settled by rare shingles.
HUB_PASSES = 2
#: Members of a class whose pairs by rare shingles are compared first, and how many times as many the next passes take.
SLICE, SLICE_GROWTH = 8, 8
#: Slots that count shingles, and the least count in a task and in all that makes a slot frequent.  They only shape the order.
SLOTS, OFTEN_IN_TASK, OFTEN = 1 << 22, 2, 8
#: Slots whose ranks come to the driver in one row, a byte each.
SLOT_BLOCK = 1 << 16

ODD = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64((1 << 44) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of texts that are joined by single spaces."""
    space = np.flatnonzero(data == 32)
    begins, ends = np.append(0, space + 1), np.append(space, len(data))
    sizes = ends - begins
    place = np.arange(len(data)) - np.repeat(begins, np.append(sizes[:-1] + 1, sizes[-1:]))
    powers = np.cumprod(np.full(int(sizes.max()) + 2, ODD))
    values = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1))[data] * powers[place]
    values[space] = 0
    return mixed(np.add.reduceat(values, begins))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and number of each distinct shingle, by text and hash.  The texts have a word at least."""
    words = np.array([t.count(b" ") + 1 for t in texts])
    with np.errstate(over="ignore"):
        hashes = word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
        total = np.zeros(len(hashes), np.uint64)
        last = np.repeat(np.cumsum(words), words) - np.arange(len(hashes))  # words from here to the end of the text
        for k in range(WORDS):
            following = np.where(last > k, np.roll(hashes, -k), np.uint64(0))
            total = mixed(total * ODD + following)
    owner = np.repeat(np.arange(len(texts)), words)
    first = np.arange(len(hashes)) - np.repeat(np.cumsum(words) - words, words) == 0
    whole = (last >= WORDS) | first
    keys = np.sort((owner[whole].astype(np.uint64) << np.uint64(44)) | (total[whole] & LOW))
    begins = np.flatnonzero(np.diff(keys, prepend=np.uint64(0) if not len(keys) else keys[0] + np.uint64(1)))
    counts = np.diff(np.append(begins, len(keys)))
    return (keys[begins] >> np.uint64(44)).astype(np.int64), keys[begins] & LOW, counts


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, texts: int) -> np.ndarray:
    """The earliest point of each component, for each text."""
    weight = np.bincount(owner, counts, texts)
    earliest = np.full((texts, COMPONENTS), np.inf)
    found = np.zeros((texts, COMPONENTS), np.uint64)
    limit = COMPONENTS / np.maximum(weight, 1) * (np.log(COMPONENTS) + 5)
    redo = np.arange(texts)[weight > 0]
    while len(redo):
        earliest[redo], found[redo] = np.inf, 0
        part = np.isin(owner, redo) if len(redo) < texts else slice(None)
        points(owner[part], hashes[part], counts[part], limit, earliest.ravel(), found.ravel())
        redo = redo[np.isinf(earliest[redo]).any(axis=1)]
        limit[redo] *= 2
    return found


def points(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, limit: np.ndarray, earliest: np.ndarray, found: np.ndarray) -> None:
    """Run the processes of all shingles and weight intervals up to their text's limit of time."""
    low, width, level = 0, 1, 0
    with np.errstate(over="ignore"):
        while True:
            inside = np.flatnonzero(counts > low)
            if not len(inside):
                return
            text, count = owner[inside], counts[inside]
            key, time = mixed(hashes[inside] * ODD + np.uint64(level)), np.zeros(len(inside))
            stop, point = limit[text], np.uint64(0)
            while len(key):
                point += np.uint64(1)
                drawn = mixed(key + point * ODD)
                time = time - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / width
                alive = time < stop
                if not alive.all():
                    key, time, text, count, stop, drawn = (x[alive] for x in (key, time, text, count, stop, drawn))
                other = mixed(drawn ^ ODD)
                place = text * COMPONENTS + (other % np.uint64(COMPONENTS)).astype(np.int64)
                when, mark = time, drawn
                if width > 1:  # cells of the interval at or above the shingle's number do not count
                    counted = low + ((other >> np.uint64(32)) % np.uint64(width)).astype(np.int64) < count
                    place, when, mark = place[counted], when[counted], mark[counted]
                np.minimum.at(earliest, place, when)
                won = earliest[place] == when
                found[place[won]] = mark[won]
            low, width, level = low + width, max(1, low + width), level + 1


def band_keys(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = signature.reshape(len(signature), BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
        for k in range(ROWS):
            key = mixed(key * ODD + parts[:, :, k])
    return key.view(np.int64)


SKETCH = "struct<digest: binary, bands: array<bigint>, sketch: binary>"


def sketch(text) -> F.Column:
    """Struct of ``digest`` (of the words), ``bands`` and ``sketch`` (a byte of each component); null without a word."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            digests, bands, bytes_ = [], [], []
            for part in pieces(texts):
                values = [normal(t) for t in part.to_pylist()]
                some = [v for v in values if v]
                if some:
                    signature = signatures(*shingles(some), len(some))
                    keys, low = iter(band_keys(signature)), iter((signature & np.uint64(255)).astype(np.uint8))
                digests += [xxhash.xxh3_128_digest(v) if v else None for v in values]
                bands += [next(keys) if v else None for v in values]
                bytes_ += [next(low).tobytes() if v else None for v in values]
            columns = [pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())]
            yield pa.StructArray.from_arrays(columns, ["digest", "bands", "sketch"])

    return F.arrow_udf(run, SKETCH)(text_or_empty(text))


def multiset(text: F.Column) -> F.Column:
    """Shingles of a text with words as bytes, sorted hashes, then their numbers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = []
            for value in texts:
                _, hashes, counts = shingles([normal(value.as_py())])
                sets.append(hashes.tobytes() + counts.astype("<u4").tobytes())
            yield pa.array(sets, pa.binary())

    return F.arrow_udf(run, "binary")(text)


def frequent_slots(sets: DataFrame) -> np.ndarray:
    """A rank for each slot of shingles that grows with the number of ``sets`` that hold one, in steps of a tenth; 0 if they are
    few.  A byte for each of ``SLOTS`` comes to the driver, however many sets there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for data in batch.column("shingles"):
                np.add.at(total, (unpacked(data.as_py())[0] % np.uint64(SLOTS)).astype(np.int64), 1)
        slots = np.flatnonzero(total >= OFTEN_IN_TASK)
        for start in range(0, len(slots), 50_000):
            part = slots[start : start + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], ["slot", "n"])

    def packed(block: pa.Table) -> pa.Table:
        ranks = np.zeros(SLOT_BLOCK, np.uint8)
        ranks[block["slot"].to_numpy() % SLOT_BLOCK] = np.minimum(8 * np.log2(block["n"].to_numpy()), 255)
        return pa.table({"block": block["block"][:1], "ranks": pa.array([ranks.tobytes()], pa.binary())})

    counted = sets.select("shingles").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    blocks = counted.filter(F.col("n") >= OFTEN).withColumn("block", F.floor(F.col("slot") / SLOT_BLOCK)).groupBy("block")
    ranks = np.zeros(SLOTS, np.uint8)
    for row in blocks.applyInArrow(packed, "block bigint, ranks binary").collect():
        ranks[row["block"] * SLOT_BLOCK :][:SLOT_BLOCK] = np.frombuffer(row["ranks"], np.uint8)
    return ranks


def rarest(sets: F.Column, ranks: np.ndarray, threshold: float, spark) -> F.Column:
    """The first shingles of each set, by the rank of their slot, then by hash, until they weigh more than two sets may differ by:
    array of shingle, n, rest (weight of what follows) and weight (of the set)."""
    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("n", pa.int64()), ("rest", pa.int64()), ("weight", pa.int64())]))
    shared = spark.sparkContext.broadcast(ranks)

    def first(data: bytes) -> list[dict]:
        hashes, counts = unpacked(data)
        order = np.lexsort((hashes, shared.value[(hashes % np.uint64(SLOTS)).astype(np.int64)]))
        weight = int(counts.sum())
        upto = np.cumsum(counts[order])
        end = int(np.searchsorted(upto - counts[order], weight - int(np.ceil(threshold * weight - 1e-9)), side="right"))
        rows = zip(hashes[order][:end].astype(np.int64).tolist(), counts[order][:end].tolist(), (weight - upto[:end]).tolist())
        return [{"shingle": h, "n": n, "rest": r, "weight": weight} for h, n, r in rows]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for data in batches:
            yield pa.array([first(d.as_py()) for d in data], kind)

    return F.arrow_udf(run, "array<struct<shingle: bigint, n: bigint, rest: bigint, weight: bigint>>")(sets)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n).astype(np.int64)


def weighted_jaccard(left: bytes, right: bytes) -> float:
    (a, n), (b, m) = unpacked(left), unpacked(right)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = b[at] == a
    shared = int(np.minimum(n[common], m[at[common]]).sum())
    return shared / (int(n.sum()) + int(m.sum()) - shared)


def agree(left: F.Column, right: F.Column) -> F.Column:
    """Components that two signatures share, by a byte of each."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pair in batches:
            a, b = (np.frombuffer(b"".join(side.to_pylist()), np.uint8).reshape(-1, COMPONENTS) for side in pair)
            yield pa.array((a == b).sum(axis=1).astype(np.int32))

    return F.arrow_udf(run, "int")(left, right)


def similarity(left: F.Column, right: F.Column) -> F.Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([weighted_jaccard(x.as_py(), y.as_py()) for x, y in zip(a, b)], pa.float64())

    return F.arrow_udf(run, "double")(left, right)


def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node that each node of the links in ``batches`` reaches."""
    links = pa.Table.from_batches(batches, pa.schema([("node", pa.int64()), ("hub", pa.int64())]))
    nodes, ends = np.unique(np.concatenate([links["node"].to_numpy(), links["hub"].to_numpy()]), return_inverse=True)
    left, right = ends[: len(links)], ends[len(links) :]
    label = np.arange(len(nodes))
    while len(apart := np.flatnonzero(label[left] != label[right])):
        one, other = label[left[apart]], label[right[apart]]
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while (further := label[label]).tobytes() != label.tobytes():
            label = further
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


class NearDuplicates:
    """One run over a table, with its intermediate tables in ``storage``."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, threshold: float, storage: str | None):
        self.spark, self.threshold = docs.sparkSession, threshold
        self.storage = storage or scratch_path(self.spark, "near-dup")
        self.tables = 0
        self.compared: list[DataFrame] = []  # pairs of the passes with hubs, the smaller node first
        # Rows are numbered once, in a written table, because ids may be null or repeated.
        self.row = free_name(docs, "row")
        self.whole = self.keep(docs.withColumn(self.row, F.monotonically_increasing_id()), "docs", "zstd")
        self.docs = self.whole.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(self.row).alias("row"))
        deviation = (COMPONENTS * threshold * (1 - threshold)) ** 0.5
        self.least_agreeing = int(COMPONENTS * threshold - 6 * deviation)

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        self.tables += 1
        path = f"{self.storage}/{self.tables:03d}-{name}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def small(self, df: DataFrame, most: int | None = None) -> DataFrame:
        return F.broadcast(df) if df.count() <= (SENT_ROWS if most is None else most) else df

    def sketches(self) -> None:
        made = self.docs.select("id", "row", sketch("text").alias("s")).select("id", "row", "s.*")
        self.rows = self.keep(made, "rows")
        same = self.rows.filter("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.min_by(F.struct("bands", "sketch"), "row").alias("s"))
        self.nodes = self.keep(same.select("node", "digest", "s.*"), "nodes")

    def candidates(self) -> None:
        bands = self.nodes.select("node", F.explode("bands").alias("band"))
        ends = bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last")
        self.members = self.keep(bands.join(ends.select("band", "hub"), "band"), "members")
        self.links = None

    def multisets(self, nodes: DataFrame) -> DataFrame:
        """Shingles of the nodes of a kept table: node, shingles.  A node is the first row of its words."""
        texts = self.docs.select(F.col("row").alias("node"), "text").join(self.small(nodes), "node")
        return self.keep(texts.select("node", multiset(F.col("text")).alias("shingles")), "sets")

    def verified(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Of distinct (node, hub) pairs those whose texts are similar enough; ``sets`` are their shingles, if there already."""
        pairs = self.keep(pairs.distinct(), "pairs")
        if sets is None:
            self.compared.append(pairs)
            sketches = self.nodes.select("node", "sketch")
            both = pairs.join(sketches, "node").join(sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("other")), "hub")
            near = self.keep(both.filter(agree(F.col("sketch"), F.col("other")) >= self.least_agreeing).select("node", "hub"), "near")
            sets = self.multisets(self.keep(near.select("node").union(near.select("hub")).distinct(), "wanted"))
        else:  # pairs of the same rare shingle and weight are close: nearly all signatures would let them pass
            near = pairs
        both = near.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("other")), "hub")
        alike = similarity(F.col("shingles"), F.col("other"))
        return self.keep(both.select("node", "hub", alike.alias("alike")).filter(F.col("alike") >= self.threshold).select("node", "hub"), "links")

    def classes(self, found: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """Labels (node, label: the smallest node that it reaches) of all linked nodes after the links ``found`` were added to those
        behind ``labels``.  They are links of classes, so a pass works on its own links and not on those of all passes again."""
        if labels is None:
            return self.small(self.components(found), SENT_LABELS)
        for end in ("node", "hub"):
            its = labels.select(F.col("node").alias(end), F.col("label").alias("its"))
            found = found.join(its, end, "left").withColumn(end, F.coalesce("its", end)).drop("its")
        apart = found.filter("node != hub").select(F.least("node", "hub").alias("node"), F.greatest("node", "hub").alias("hub"))
        edges = self.keep(apart.distinct(), "edges")
        if edges.isEmpty():
            return labels
        joined = self.small(self.components(edges), SENT_LABELS)
        moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left")
        moved = moved.select("node", F.coalesce("now", "label").alias("label"))
        return self.small(self.keep(moved.union(joined.join(labels, "node", "left_anti").select("node", "label")), "labels"), SENT_LABELS)

    def components(self, links: DataFrame) -> DataFrame:
        """The smallest node that each linked node reaches, by one task or in rounds."""
        if links.count() <= ONE_TASK_LINKS:
            return self.keep(links.select("node", "hub").coalesce(1).mapInArrow(reached, "node bigint, label bigint"), "reached")
        return self.propagated(links)

    def propagated(self, links: DataFrame) -> DataFrame:
        """As ``components``: labels go over links and follow one another until none changes."""
        edges = links.select("node", F.col("hub").alias("to")).union(links.select(F.col("hub").alias("node"), F.col("node").alias("to")))
        edges = self.keep(edges, "ends")
        labels = self.keep(edges.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("label")), "labels")
        while True:
            offered = edges.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("offer"))
            heard = labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
            heard = self.keep(heard, "heard")
            far = heard.select(F.col("node").alias("label"), F.col("label").alias("further"))
            labels = self.keep(heard.join(far, "label", "left").select("node", "old", F.coalesce("further", "label").alias("label")), "labels")
            if labels.filter("label != old").isEmpty():
                return labels.select("node", "label")
            labels = labels.select("node", "label")

    def open_members(self, labels: DataFrame) -> DataFrame:
        """Members of the buckets whose nodes are in several classes: band, node, label."""
        now = self.members.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
        several = now.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("band")
        return self.keep(now.join(several, "band", "left_semi"), "open")

    def join(self) -> DataFrame:
        """Labels of all linked nodes, after every pair that could join two classes was compared."""
        self.links = self.verified(self.members.filter("node != hub").select(F.col("hub").alias("node"), F.col("node").alias("hub")))
        labels = self.classes(self.links)
        for turn in range(1, HUB_PASSES):
            self.members = opened = self.open_members(labels)
            if opened.isEmpty():
                return labels
            order = F.xxhash64("node", F.lit(turn))
            hubs = opened.groupBy("band").agg(F.min(F.struct(order.alias("order"), F.col("node").alias("hub"), F.col("label").alias("its"))).alias("h")).select("band", "h.hub", "h.its")
            labels = self.more(opened.join(hubs, "band").filter("label != its"), labels)
        self.members = opened = self.open_members(labels)
        if opened.isEmpty():
            return labels
        nodes = self.sliced(opened)
        sets = self.multisets(nodes.select("node"))
        first = sets.select("node", F.inline(rarest(F.col("shingles"), frequent_slots(sets), self.threshold, self.spark)))
        first = self.keep(first.join(nodes, "node"), "rarest")
        for turn in range(nodes.agg(F.max("slice")).first()[0] + 1):
            labels = self.more(self.rare_pairs(first, labels, turn), labels, sets)
        return labels

    def sliced(self, opened: DataFrame) -> DataFrame:
        """Open nodes with ``outside``, whether one is outside the main class of a bucket, and ``slice``: the members of a class are
        dealt into a slice of about ``SLICE``, one that makes it ``SLICE_GROWTH`` times as many, and so on."""
        sizes = opened.groupBy("band", "label").count()
        main = sizes.groupBy("band").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        nodes = opened.join(main, "band").groupBy("node", "label").agg(F.bool_or(F.col("label") != F.col("main")).alias("outside"))
        classes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        place = F.pmod(F.xxhash64("node", F.lit(HUB_PASSES)), F.lit(1 << 30)) / F.lit(1 << 30) * F.col("size")
        number = F.when(place < SLICE, 0).otherwise(F.floor(F.log(place / SLICE) / F.log(F.lit(float(SLICE_GROWTH)))) + 1)
        return self.keep(nodes.join(classes, "label").select("node", "outside", number.cast("int").alias("slice")), "slices")

    def rare_pairs(self, first: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
        """Pairs of nodes in different classes that share one of their rarest shingles, one of them outside a main class, the later
        of their slices being ``turn``."""
        now = first.filter(F.col("slice") <= turn).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = now.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("size"), F.max("slice").alias("top"))
        held = sizes.groupBy("shingle").agg(
            F.max_by("label", F.struct("size", "label")).alias("main"), F.min("label").alias("a"), F.max("label").alias("b"), F.max("top").alias("top")
        )
        held = held.filter((F.col("a") < F.col("b")) & (F.col("top") == turn)).select("shingle", "main")
        now = self.keep(now.join(held, "shingle"), "rare")
        # Of two classes one is not the shingle's main class, so its members need no pairs with one another.
        other = {"node": "hub", "label": "its", "n": "m", "rest": "its_rest", "weight": "its_weight", "outside": "its_outside", "slice": "its_slice"}
        theirs = now.filter("label != main").drop("main").withColumnsRenamed(other)
        # Of a pair that is similar enough the first shingle both share passes; the others of it need not.
        shared = F.least("n", "m") + F.least("rest", "its_rest")
        enough = shared >= self.threshold / (1 + self.threshold) * (F.col("weight") + F.col("its_weight")) - 1e-6
        wanted = (F.col("label") != F.col("its")) & (F.col("outside") | F.col("its_outside")) & (F.greatest("slice", "its_slice") == turn)
        return now.join(theirs, "shingle").filter(wanted & enough).select("node", "hub")

    def more(self, pairs: DataFrame, labels: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Labels after the pairs were compared that no pass with hubs has; two slices have no pair in common."""
        fresh = pairs.select(F.least("node", "hub").alias("node"), F.greatest("node", "hub").alias("hub")).filter("node != hub").distinct()
        fresh = fresh.join(reduce(DataFrame.union, self.compared), ["node", "hub"], "left_anti")
        found = self.verified(fresh, sets)
        self.links = self.links.union(found)
        return self.classes(found, labels)

    def result(self) -> DataFrame:
        """Each row with its class, and its number in ``whole``."""
        self.sketches()
        self.candidates()
        labels = self.join()
        named = self.nodes.select("node", "digest").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
        rows = self.rows.select("id", "row", "digest").join(named, "digest", "left")
        rows = self.keep(rows, "labelled")
        keeper = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("keep")
        classes = rows.filter("label is not null").groupBy("label").agg(keeper, F.count(F.lit(1)).alias("class_size"))
        joined = rows.join(classes, "label", "left")
        alone = F.col("label").isNull()
        return joined.select(
            "id",
            F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("class_id"),
            F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
            F.coalesce(F.col("row") == F.col("keep.row"), F.lit(True)).alias("kept"),
            "digest",
            "row",
        )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, storage: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, class_id (smallest id of its class), class_size, kept (one row of each class), digest of
    its words.  ``storage`` is a folder that all executors reach; without it one below ``spark.checkpoint.dir`` is taken."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return NearDuplicates(docs, "id", "text", threshold, storage).result().drop("row")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, storage: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each class, whether ids are null, repeated or neither."""
    run = NearDuplicates(docs, id_col, text_col, threshold, storage)
    gone = run.keep(run.result().filter("not kept").select(F.col("row").alias(run.row)), "gone")
    return run.whole.join(run.small(gone), run.row, "left_anti").drop(run.row)
