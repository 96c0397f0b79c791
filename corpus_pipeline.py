"""From raw documents to encoded training text, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import byte_bpe, decontaminate, language_crf, near_dup, stream_dedup
from tabwright.llm.columns import bounded_batches, free_name
from tabwright.session import scratch_path

#: Least mean probability of a document's language over its words.
LEAST_LANGUAGE_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are mostly of one language go on; those without a letter or with a low score go."""
    bounded_batches(spark)
    model = language_crf.fit_documents(docs)
    found = free_name(docs, "found")
    scored = docs.withColumn(found, language_crf.predict("text", model, spark))
    return scored.filter((F.col(f"{found}.lang") != language_crf.UNDETERMINED) & (F.col(f"{found}.score") >= LEAST_LANGUAGE_SCORE)).drop(found)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id goes on."""
    return stream_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates goes on."""
    bounded_batches(spark)
    return near_dup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands go on."""
    bounded_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their whole texts, their number, and whether the decoded ids give the text again."""
    bounded_batches(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids, n_tokens, round_trip, coded = (free_name(docs, name) for name in ("ids", "n_tokens", "round_trip", "coded"))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = docs.withColumn(coded, byte_bpe.encode_and_decode("text", *vocabulary)).withColumn(ids, F.col(f"{coded}.ids"))
    return docs.withColumn(n_tokens, F.size(ids).cast("long")).withColumn(round_trip, F.col(f"{coded}.decoded") == text).drop(coded)


STAGES = [
    ("language ID", keep_known_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode),
]

#: SQL has no trained model, no sketch and no token merges; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
