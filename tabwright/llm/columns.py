"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch.  Texts are large, and a worker holds a batch and its results at once.
BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

#: Text bytes that an operator handles at once inside an Arrow batch.
PIECE_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, unless the session was started with its own setting."""
    own = spark.sparkContext.getConf()
    for key, value in BATCH_SETTINGS.items():
        if own.get(key) is None:
            spark.conf.set(key, value)
    return spark


def text_or_empty(column: str | Column) -> Column:
    """The column as text; null counts as empty."""
    column = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """``texts`` in order, in slices of at most ``limit`` bytes or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(texts):
        yield texts.slice(start)
