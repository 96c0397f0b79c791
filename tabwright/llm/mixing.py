"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source gets a share of the whole size by its weight, at most ``most_epochs`` times its own size; what is above goes to the other
sources by weight, until none is above.  A source gives as many complete epochs as fit its target.  What remains is filled
by sampling without replacement: every document has an exponential variable, made from its id and a seed, divided by its quality weight;
documents are taken in ascending order of that key until their sizes fill the rest.  The last one is taken in part, so a source
meets its target to the word.

The order within a source is never made by one task.  Keys are mapped to integers of 30 bits, and the place where the rest is full is
narrowed three times by 10 bits: the sizes of at most 1024 ranges of a source are summed up in one pass, and the range in which the
sum passes the rest is looked into next.  Only the documents of the last range (a 2^-30 part of a source, or equal keys) are sorted.

Defined cases: a null or empty text has size 0 and nothing of it is taken; null sources are one source, which comes last; a null id is
one id; rows with the same id have the same key, the smaller size first, and are otherwise interchangeable; a weight
that is null or not positive counts as the least; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.columns import text_or_empty
from tabwright.operators.ranks import row_index
from tabwright.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: ASCII digits and marks; the share of other characters is the quality weight that ``quality_weight`` gives.
JUNK = r"[\x21-\x40\x5B-\x60\x7B-\x7E]"
LEAST_WEIGHT = 0.05
STEPS, STEP_BITS = 3, 10
KEY_BITS = STEPS * STEP_BITS
#: Sources up to which their table is broadcast; above, joins shuffle.
SMALL_SOURCES = 100_000


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def quality_weight(text: str | Column) -> Column:
    """Share of the characters that are no digits or marks, at least ``LEAST_WEIGHT``; 1 for an empty text."""
    text = text_or_empty(text)
    clean = F.char_length(F.regexp_replace(text, JUNK, ""))
    return F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(F.try_divide(clean, F.char_length(text)), F.lit(1.0)))


def order_key(id_col: str, weight: Column, seed: str) -> Column:
    """The exponential key as an integer: ``u`` is uniform in (0, 1], ``-ln(u) / weight`` is the key, and ``1 - exp(-key)``,
    which has the same order, is cut to ``KEY_BITS`` bits."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    weight = F.when(weight >= LEAST_WEIGHT, weight).otherwise(F.lit(LEAST_WEIGHT))
    place = F.floor((1 - F.pow(uniform, 1 / weight)) * float(1 << KEY_BITS))
    return F.least(place, F.lit((1 << KEY_BITS) - 1)).cast("long")


def source_targets(sizes: DataFrame, weight: Column, most_epochs: int = 3) -> DataFrame:
    """``sizes`` (with ``source_size`` and a positive whole number ``weight``) with ``target`` for each source."""
    whole, weights = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))).first()
    rest, open_weights = whole, weights
    most = F.col("source_size") * most_epochs
    while True:
        share = F.lit(float(rest)) * weight / F.lit(float(open_weights or 1))
        above = share > most
        capped, still_open = sizes.agg(
            F.coalesce(F.sum(F.when(above, most)), F.lit(0)), F.coalesce(F.sum(F.when(~above, weight)), F.lit(0))
        ).first()
        if still_open == open_weights or not still_open:
            return sizes.withColumn("target", F.when(above, most.cast("double")).otherwise(share))
        rest, open_weights = whole - capped, still_open


def cut_of(ranges: Column, before: Column, rest: Column) -> Column:
    """The first range at whose end the sum reaches ``rest``, and the sum before it."""
    start = F.struct(F.lit(None).cast("long").alias("at"), before.alias("before"))

    def onward(state: Column, r: Column) -> Column:
        reached = state.at.isNull() & (state.before + r.words >= rest)
        return F.struct(
            F.when(reached, r.part).otherwise(state.at).alias("at"),
            F.when(state.at.isNotNull() | reached, state.before).otherwise(state.before + r.words).alias("before"),
        )

    return F.aggregate(F.array_sort(ranges), start, onward)


def mix_sources(
    docs: DataFrame,
    size: Column,
    quality: Column,
    source_weights: tuple[int, ...] = (1, 2, 3),
    most_epochs: int = 3,
    id_col: str = "doc_id",
    source_col: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, epochs (complete ones) and taken (of ``size``,
    repeats counted).  Sources, in order of code points and null last, weigh ``source_weights``, repeating."""
    rows = materialize(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
            order_key(id_col, quality, seed).alias("key"),
        ),
        "mix-rows",
    )
    sizes = row_index(rows.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "place")
    weights = F.array(*map(F.lit, source_weights))
    sizes = sizes.withColumn("weight", F.get(weights, (F.col("place") % len(source_weights)).cast("int")))
    targets = source_targets(sizes, F.col("weight"), most_epochs)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.select(
        F.col("source").alias("its_source"), "source_size", "target", epochs.alias("epochs"),
        (budget - epochs * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("before"),
    )
    state = materialize(state, "mix-sources")
    few = state.count() <= SMALL_SOURCES

    def with_state(state: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(state) if few else state, rows.source.eqNullSafe(state.its_source)).drop("its_source")

    for step in range(1, STEPS + 1):
        shift = KEY_BITS - STEP_BITS * step
        inside = with_state(state).filter((F.col("rest") > 0) & (F.shiftright("key", shift + STEP_BITS) == F.col("cut")))
        parts = inside.groupBy("source", F.shiftright("key", shift).alias("part")).agg(F.sum("size").alias("words"))
        ranges = parts.groupBy("source").agg(F.collect_list(F.struct("part", "words")).alias("ranges"))
        found = state.join(ranges, F.col("its_source").eqNullSafe(F.col("source")), "left")
        found = found.withColumn("found", cut_of(F.col("ranges"), F.col("before"), F.col("rest")))
        state = materialize(found.select(
            "its_source", "source_size", "target", "epochs", "rest",
            F.coalesce("found.at", F.lit(-1)).cast("long").alias("cut"), F.coalesce("found.before", "before").alias("before"),
        ), "mix-sources")

    placed = with_state(state)
    first = Window.partitionBy("source").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.filter(F.col("key") == F.col("cut")).withColumn("earlier", F.col("before") + F.coalesce(F.sum("size").over(first), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("earlier")))
    whole = placed.filter(F.col("key") != F.col("cut")).withColumn("earlier", F.lit(None).cast("long"))
    full = F.when(F.col("key") < F.col("cut"), F.col("size")).otherwise(0)
    extra = F.when(F.col("earlier").isNull(), full).otherwise(more)
    result = whole.unionByName(last).withColumn("taken", (F.col("epochs") * F.col("size") + extra).cast("long"))
    return result.select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")
