"""Large JSON bodies: the records of one list in one file are read by many tasks.

A file is cut behind each ``}`` by Spark's text reader, which deals out byte ranges.  Where a range begins, nesting and quotes are not
known.  A first pass gives, for each range, how it changes them if it begins outside a text and if it begins inside one; running sums
over the ranges of a file (one row each) then give the true beginning of each.  A second pass cuts out the records.  A record that reaches over
the end of a range comes in parts, which are put together by their place in the list; all other records never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tabwright.session import scratch_path

TOKEN = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
ESCAPE = re.compile(r"\\.", re.DOTALL)
#: Ranges whose beginnings may be sent to all tasks (about 200 bytes each); beyond it the join shuffles.
SENT_RANGES = 100_000

RANGE = "source string, start bigint"
CHANGE = f"{RANGE}, quotes int, outside bigint, inside bigint"
CUT = f"{RANGE}, kind string, carried boolean, k bigint, value string, n_carried bigint, n_known bigint, last boolean"


def earlier(c: Column) -> Column:
    """``c`` over the earlier ranges of the same file."""
    return c.over(Window.partitionBy("source").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))


def nesting(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each byte range does to quotes and nesting, from either beginning."""
    found: dict[tuple, list[int]] = {}
    for batch in batches:
        for source, start, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            parts = ESCAPE.sub("", value + "}").split('"')
            even, odd = nesting("".join(parts[::2])), nesting("".join(parts[1::2]))
            state = found.setdefault((source, start), [0, 0, 0])
            state[1] += odd if state[0] else even
            state[2] += even if state[0] else odd
            state[0] ^= 1 - len(parts) % 2
    rows = [(*key, *state) for key, state in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW_CHANGE.types)] if rows else [pa.array([], t) for t in ARROW_CHANGE.types], schema=ARROW_CHANGE)


ARROW_CHANGE = pa.schema([("source", pa.string()), ("start", pa.int64()), ("quotes", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64())])
ARROW_CUT = pa.schema(
    [("source", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("carried", pa.bool_()), ("k", pa.int64()), ("value", pa.string())]
    + [("n_carried", pa.int64()), ("n_known", pa.int64()), ("last", pa.bool_())]
)


class RangeReader:
    """Records of one byte range.  ``listed`` is whether the list is open: None as long as an earlier range has to tell."""

    def __init__(self, source: str, start: int, inside: bool, depth: int, opening: re.Pattern):
        self.key, self.inside, self.depth, self.opening = (source, start), inside, depth, opening
        self.listed = None if depth >= 2 else False
        self.counts = {True: 0, False: 0}  # records by whether the range began inside their list
        self.place, self.begun = (True, -1), [] if depth >= 3 else None  # of the record that is being read, and its text

    def begin(self) -> None:
        carried = self.listed is None
        self.place, self.begun = (carried, self.counts[carried]), []
        self.counts[carried] += 1

    def row(self, kind: str) -> tuple:
        text, self.begun = "".join(self.begun), None
        return (*self.key, kind, *self.place, text, None, None, None)

    def read(self, text: str) -> Iterator[tuple]:
        if self.begun is None and not self.inside and self.depth == 2 and self.listed is not False:
            parts = (ESCAPE.sub("", text) if "\\" in text else text).split('"')
            outer, record = "".join(parts[::2]), text.lstrip(", \n\r\t")
            if len(parts) % 2 and record[0] == "{" and outer.count("{") == outer.count("}") == 1 and "[" not in outer and "]" not in outer:
                self.begin()
                self.begun = [record]
                yield self.row("record")
                return
        at = 0
        for m in TOKEN.finditer(text):
            token = m.group()
            if token == '"':
                self.inside = not self.inside
            elif self.inside or token[0] == "\\":
                continue
            elif token in "{[":
                if self.depth == 1:
                    self.listed = token == "[" and self.opening.search(text, 0, m.start()) is not None
                elif self.depth == 2 and token == "{" and self.listed is not False:
                    self.begin()
                    at = m.start()
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == 2 and self.begun is not None:
                    self.begun.append(text[at : m.end()])
                    yield self.row("part" if self.place[1] < 0 else "record")
                if self.depth < 2:
                    self.listed = False
        if self.begun is not None:
            self.begun.append(text[at:])

    def end(self) -> Iterator[tuple]:
        if self.begun is not None:
            yield self.row("part")
        yield (*self.key, "end", None, None, None, self.counts[True], self.counts[False], self.listed)


def cut_records(name: str):
    opening = re.compile(rf'"{re.escape(name)}"\s*:\s*$')

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            rows: list[tuple] = []
            for source, start, inside, depth, value in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if reader is None or reader.key != (source, start):
                    rows += reader.end() if reader else ()
                    reader = RangeReader(source, start, inside, depth, opening)
                rows += reader.read(value + "}")
            yield as_batch(rows)
        if reader:
            yield as_batch(list(reader.end()))

    return run


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(ARROW_CUT)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW_CUT.types)], schema=ARROW_CUT)


def read_list_records(spark: SparkSession, path: str, name: str = "houses") -> DataFrame:
    """``source``, ``position`` and ``value`` (the JSON text) of the objects in the list ``name`` of each file's outermost object.

    A file that ends inside a text or an object, or that closes more than it opens, has one row instead, with ``error``.  Elements of the
    list that are no objects are not defined.  The records are written once to the shared folder."""
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"), "value")
    storage = scratch_path(spark, "json-list")

    def kept(df: DataFrame, table: str) -> DataFrame:
        df.write.parquet(f"{storage}/{table}")
        return spark.read.schema(df.schema).parquet(f"{storage}/{table}")

    ranges = kept(pieces.mapInArrow(changes, CHANGE), "ranges")
    quoted = F.coalesce(earlier(F.sum("quotes")), F.lit(0)) % 2 == 1
    begins = ranges.withColumn("quoted", quoted).withColumn("change", F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside")))
    begins = kept(begins.withColumn("depth", F.coalesce(earlier(F.sum("change")), F.lit(0))), "begins")
    few = begins.count() <= SENT_RANGES
    known = begins.select("source", "start", "quoted", "depth")
    ordered = pieces.withColumn("piece", F.monotonically_increasing_id()).join(F.broadcast(known) if few else known, ["source", "start"])
    if not few:  # the join has dealt the pieces out anew
        ordered = ordered.sortWithinPartitions("source", "start", "piece")
    found = kept(ordered.select("source", "start", "quoted", "depth", "value").mapInArrow(cut_records(name), CUT), "records")

    # The text behind the last brace has one added to it, so a whole file ends at -1, or at 0 if nothing follows that brace.
    whole = begins.groupBy("source").agg((F.sum("quotes") % 2 == 0).alias("closed"), F.sum("change").alias("change"))
    broken = whole.filter(~(F.col("closed") & F.col("change").isin(-1, 0))).select("source")
    ends = found.filter("kind = 'end'").select("source", "start", "n_carried", "n_known", "last")
    open_ = F.coalesce(earlier(F.last("last", ignorenulls=True)), F.lit(False))
    ends = ends.withColumn("open", open_).withColumn("of_earlier", F.when(F.col("open"), F.col("n_carried")).otherwise(0))
    ends = ends.withColumn("base", F.coalesce(earlier(F.sum(F.col("of_earlier") + F.col("n_known"))), F.lit(0)))
    ends = kept(ends.join(broken, "source", "left_anti").select("source", "start", "open", "of_earlier", "base"), "ends")
    records = found.filter("kind != 'end'").select("source", "start", "kind", "carried", "k", "value")
    placed = records.join(F.broadcast(ends) if few else ends, ["source", "start"]).filter("open OR NOT carried")
    placed = placed.withColumn("position", F.col("base") + F.col("k") + F.when(F.col("carried"), 0).otherwise(F.col("of_earlier")))
    parts = F.array_sort(F.collect_list(F.struct("start", "value")))
    joined = placed.filter("kind = 'part'").groupBy("source", "position").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value"))
    rows = placed.filter("kind = 'record'").select("source", "position", "value").unionByName(joined)
    refused = broken.select("source", F.lit("the file is no complete JSON body").alias("error"))
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(refused, allowMissingColumns=True)
