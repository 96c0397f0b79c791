"""Exact dedup as a stateful stream.

Each row becomes an arrival: the digest of its whole text, its stable identifier, its locator (batch and row) and its content.
The arrivals of one call are a folder, its batch; all batches are read by one stream, whose state, kept on disk by RocksDB and
without expiry, holds for each digest the largest identifier, its locator and the number of rows.  The stream and the state read
no content.  Rows of a digest are combined before the shuffle, so a digest with a third of all rows reaches its state as one row a
task.  Afterwards the state is read as a table.

A digest that is hit more than once is only a candidate: the full text of each such row is compared with the full text at
the state's locator, for all digests that the new batch touches.  Digests under which texts differ (none, with SHA-256) are
grouped again by the texts themselves.

Started again: a call with the storage of an earlier one adds its rows to it and gives the groups of all rows.  A call that names
its batch may be repeated, after a failure or not: a batch that was written whole is not taken in twice, and one that was cut off
is written anew before the stream sees it; until then the storage takes no other batch.  Without a name each call is a new batch.

Defined cases: null text counts as empty, and empty texts are equal; a null identifier is smaller than all others;
of rows that repeat both identifier and text exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.columns import free_name, text_or_empty
from tabwright.session import scratch_path

#: State on disk; without setting room aside, as each of many small stores would take 4 MB; with one bound for the memory of all
#: stores of an executor.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
}
#: Rows of a table of digests that may be sent to all executors (about 100 bytes each); beyond it the join shuffles.
SENT_ROWS = 100_000
#: Rows from which on a group is compared by several tasks, and how many.
HOT_ROWS, SALTS = 1000, 32
ARRIVAL = "id bigint, digest binary, locator struct<batch: string, row: bigint>"
CONTENT = f"{ARRIVAL}, text string"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def batches(spark: SparkSession, folder: str) -> set[str]:
    """Names noted below ``folder``, one a call."""
    try:
        return {r.batch for r in spark.read.schema("batch string").parquet(f"{folder}/*").collect()}
    except AnalysisException:  # no call yet
        return set()


def note(spark: SparkSession, folder: str, batch: str) -> None:
    spark.range(1).coalesce(1).select(F.lit(batch).alias("batch")).write.mode("overwrite").parquet(f"{folder}/{batch}")


def arrive(docs: DataFrame, storage: str, batch: str, id_col: str, text_col: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Write the arrivals of ``docs`` as ``batch``, unless that batch is there already."""
    spark = docs.sparkSession
    written = batches(spark, f"{storage}/written")
    if batch in written:
        return
    if cut_off := batches(spark, f"{storage}/begun") - written - {batch}:
        raise RuntimeError(f"repeat these batches first, which were cut off: {sorted(cut_off)}")  # the stream would see a part of them
    note(spark, f"{storage}/begun", batch)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.select(
        "id",
        digest(F.col("text")).alias("digest"),
        F.struct(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("row")).alias("locator"),
        "text",
    )
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{storage}/arrivals/{batch}")
    note(spark, f"{storage}/written", batch)


def arrivals(spark: SparkSession, storage: str, schema: str = ARRIVAL) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{storage}/arrivals/*")


def run_stream(spark: SparkSession, storage: str, files_at_once: int | None = None) -> DataFrame:
    """Take in the arrivals that are new since the last start, then read the state: digest, keep, group_size."""
    reader = spark.readStream.schema(ARRIVAL)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    seen = reader.parquet(f"{storage}/arrivals/*").groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        query = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{storage}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    state = spark.read.format("statestore").load(f"{storage}/state")
    return state.select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("group_size"))


def differing(spark: SparkSession, storage: str, batch: str, groups: DataFrame) -> DataFrame:
    """Of the digests of ``batch`` those under which some text is not the text that the state points to."""
    new = spark.read.schema(ARRIVAL).parquet(f"{storage}/arrivals/{batch}").select("digest")
    salts = F.when(F.col("group_size") > HOT_ROWS, SALTS).otherwise(1)
    hits = groups.filter("group_size > 1").join(new, "digest", "left_semi").select("digest", F.col("keep.locator").alias("kept_at"), salts.alias("salts"))
    hits.write.mode("overwrite").parquet(f"{storage}/hits/{batch}")
    hits = spark.read.parquet(f"{storage}/hits/{batch}")
    rows = arrivals(spark, storage, CONTENT).join(small(hits, hits.count()), "digest")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("locator"), F.col("salts")))
    kept = rows.filter("locator = kept_at").select("digest", F.col("text").alias("kept_text"), "salts")
    # The rows of a large group are compared by many tasks, each with a copy of the text that stays.
    kept = kept.select("digest", "kept_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return rows.select("digest", "salt", "text").join(kept, ["digest", "salt"]).filter("text != kept_text").select("digest").distinct()


def located_groups(docs: DataFrame, storage: str, batch: str, id_col: str, text_col: str, digest: Callable[[Column], Column], files_at_once: int | None) -> DataFrame:
    """One row per arrival of all batches: id, digest, locator, keep_id, group_size, kept."""
    spark = docs.sparkSession
    arrive(docs, storage, batch, id_col, text_col, digest)
    state = f"{storage}/groups/{uuid.uuid4().hex}"
    run_stream(spark, storage, files_at_once).write.parquet(state)
    groups = spark.read.parquet(state)
    differing(spark, storage, batch, groups).write.mode("overwrite").parquet(f"{storage}/differing/{batch}")
    columns = "id", "digest", "locator", F.col("keep.id").alias("keep_id"), "group_size", (F.col("locator") == F.col("keep.locator")).alias("kept")
    result = arrivals(spark, storage).join(groups, "digest").select(*columns)
    wrong = spark.read.schema("digest binary").parquet(f"{storage}/differing/*").distinct()
    if wrong.isEmpty():
        return result
    rows = arrivals(spark, storage, CONTENT).join(wrong, "digest", "left_semi")
    by_text = rows.groupBy("digest", "text").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return result.join(wrong, "digest", "left_anti").unionByName(rows.join(by_text, ["digest", "text"]).select(*columns))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    storage: str | None = None,
    files_at_once: int | None = None,
    batch: str | None = None,
) -> DataFrame:
    """One row per row of ``docs`` and of all batches that ``storage`` took in before: id, digest, keep_id, group_size, kept.
    ``storage`` is a folder that all executors reach; without it one below the session's ``spark.checkpoint.dir`` is taken.
    A call with the same ``batch`` may be repeated; ``digest`` must be the same for all calls on one storage."""
    storage, batch = storage or scratch_path(docs.sparkSession, "exact-dedup"), batch or uuid.uuid4().hex
    return located_groups(docs, storage, batch, id_col, text_col, digest, files_at_once).drop("locator")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", storage: str | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; with an earlier ``storage``, against all its rows too."""
    spark = docs.sparkSession
    storage, batch = storage or scratch_path(spark, "exact-dedup"), batch or uuid.uuid4().hex
    folder = f"{storage}/decided/{batch}"
    mine = located_groups(docs, storage, batch, id_col, text_col, sha256, None).filter(F.col("locator.batch") == batch)
    mine.select("id", "digest", "kept").write.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    digest, key = free_name(docs, "digest"), F.col(f"`{id_col}`").cast("bigint")
    docs = docs.withColumn(digest, sha256(text_or_empty(text_col)))
    gone = rows.groupBy("digest", "id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    gone.filter("not kept").select("digest", "id").write.mode("overwrite").parquet(f"{folder}/gone")
    gone.filter("kept and rows > 1").select("digest", "id").write.mode("overwrite").parquet(f"{folder}/repeated")

    def named(table: str) -> tuple[DataFrame, Column]:
        table = spark.read.schema("digest binary, id bigint").parquet(f"{folder}/{table}")
        other = small(table.select(F.col("digest").alias("its_digest"), F.col("id").alias("its_id")), table.count())
        return other, (F.col(f"`{digest}`") == other.its_digest) & key.eqNullSafe(other.its_id)

    left = docs.join(*named("gone"), "left_anti")
    repeated = named("repeated")
    if repeated[0].isEmpty():
        return left.drop(digest)
    once = left.join(*repeated, "left_semi").dropDuplicates([digest, id_col])
    return left.join(*repeated, "left_anti").unionByName(once).drop(digest)
