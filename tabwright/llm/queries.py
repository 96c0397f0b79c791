"""Registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import (
    byte_bpe,
    chat_format,
    conversation_repair,
    conversation_trie,
    decontaminate,
    language_crf,
    mixing,
    near_dup,
    pii_weak,
    quality_em,
    secret_scan,
    stream_dedup,
    token_counts,
)
from tabwright.llm.columns import bounded_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


@query("op1_quality_em")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_em.quality(table(spark, sf_dir, "documents"))


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = table(spark, sf_dir, "documents").select("doc_id", byte_bpe.encode("text", *vocabulary).alias("ids"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decode("ids", *vocabulary), 256).alias("decoded_sha256"),
    )


@query(
    "op5_stream_dedup",
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
         g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.text) AS text_sha256
    FROM t JOIN g ON t.text = g.text
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = stream_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op6_prefix_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    counted = documents.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        token_counts.count_prefixes("text", public_tokenizers.path("piece_bpe_32k.model")).alias("counts"),
    )
    return counted.select("doc_id", "n_bytes", "counts.n_tokens", (F.col("counts.n_tokens") > 4096).alias("over_limit"))


@query(
    "op10_chat_format",
    r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
    ), e AS (
        SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS chars FROM t
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_conversations(turns))


@query("op3_language_crf")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_crf.fit_documents(documents)
    predicted = documents.select("doc_id", language_crf.predict("text", model, spark).alias("found"))
    return predicted.select("doc_id", language_crf.held_out("doc_id").alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


@query("op7_bag_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


@query("op8_pigeonhole_edits")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_pii_weak")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_weak.personal_data(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.filter("spans", lambda s: s.base & (s.kind == kind))
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in pii_weak.BASE_KINDS]
    base = written(F.filter("spans", lambda s: s.base))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query("op9_entropy_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.filter("spans", lambda s: s.kind == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS]
    base = F.filter("spans", lambda s: s.place < len(secret_scan.BASE_KINDS))
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


#: CRC-32 of a short ASCII text, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split({}, '')]),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""


@query("op11_repair_astar")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    plans, repaired = conversation_repair.repair(turns, conversation_repair.damaged(turns))
    digests = conversation_repair.line_digests(repaired).withColumnRenamed("conv_id", "its_id")
    return plans.join(digests, F.col("conv_id").eqNullSafe(F.col("its_id"))).drop("its_id")


@query(
    "op12_mix_sources",
    r"""
    WITH d AS (
        SELECT doc_id, source, coalesce(text, '') AS text, ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT AS h FROM documents
    ), r AS (
        SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS size, CAST(h AS DOUBLE) + 1 AS u,
               greatest(0.05, coalesce(length(regexp_replace(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) / nullif(length(text), 0), 1.0)) AS weight
        FROM d
    ), k AS (
        SELECT doc_id, source, size, least(1073741823, CAST(floor((1 - pow(u / 4503599627370496, 1 / weight)) * 1073741824) AS BIGINT)) AS key FROM r
    ), s AS (
        SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
        FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source)
    ), c AS (
        SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM s
    ), l AS (
        SELECT a.source, a.ratio,
               CAST((SELECT sum(source_size) FROM c) - coalesce((SELECT sum(3 * b.source_size) FROM c b WHERE b.ratio < a.ratio), 0) AS DOUBLE) AS rest,
               CAST((SELECT sum(b.w) FROM c b WHERE b.ratio >= a.ratio) AS DOUBLE) AS open
        FROM c a
    ), f AS (
        SELECT rest, open FROM l WHERE rest / open <= ratio ORDER BY ratio LIMIT 1
    ), t AS (
        SELECT source, source_size, CASE WHEN rest * w / open > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE rest * w / open END AS target FROM c, f
    ), p AS (
        SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs,
               coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
        FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - earlier)) AS BIGINT) AS taken
    FROM p
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    mixed = mixing.mix_sources(documents, mixing.word_count("text"), mixing.quality_weight("text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op13_prefix_trie",
    rf"""
    WITH t AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
        FROM conversations WHERE conv_id IS NOT NULL
    ), c AS (
        SELECT conv_id, count(*) AS own, {CRC32_SQL.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t GROUP BY conv_id
    ), r AS (
        SELECT c.conv_id, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.place <= c.h
        UNION ALL SELECT c.conv_id, 1000000 + t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h
    ), q AS (
        SELECT conv_id, place, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER w AS depth,
               md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ) OVER w) AS prefix
        FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place)
    ), p AS (
        SELECT conv_id, depth, prefix, lag(prefix, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS parent, words FROM q
        UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM c
    ), l AS (
        SELECT conv_id, max(depth) AS turns FROM p GROUP BY conv_id
    ), n AS (
        SELECT prefix, depth, any_value(parent) AS parent, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
               sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (depth = turns), '')) AS ends_sha256
        FROM p JOIN l USING (conv_id) GROUP BY prefix, depth
    ), k AS (
        SELECT a.prefix, count(b.prefix) AS n_children FROM n a LEFT JOIN n b ON b.parent = a.prefix GROUP BY a.prefix
    ), u AS (
        SELECT DISTINCT a.prefix AS top, n.prefix, n.saved, k.n_children
        FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth JOIN n ON n.prefix = b.prefix JOIN k ON k.prefix = n.prefix
    ), s AS (
        SELECT top AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM u GROUP BY top
    )
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM n JOIN k USING (prefix) JOIN s USING (prefix) LEFT JOIN n m ON m.prefix = n.parent
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_trie.trie_nodes(*conversation_trie.rebuilt(conversation_trie.turn_rows(turns)))
