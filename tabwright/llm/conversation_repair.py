"""Repair of conversations by iterative-deepening A*.

A row may be kept (cost 0), get the role user or assistant (1) or be deleted (2); a turn without text may be inserted anywhere (5).  A
row that is blank or a copy must be deleted; one that breaks off costs 5 more if it is not.  The initials of the roles that
remain must read ``(s?(ua)+)?``.  The answer is the cheapest sequence of edits and, of equally cheap ones, the least in ASCII order of
their initials D, I, K, R.

``search`` goes depth first, in that order, through all sequences within a bound on cost so far plus the least cost of what is left (a
sum of the least cost of each row).  The next bound is the least sum that was above the last one, so the first accepted sequence is the
answer.  A table of failed states holds, for each row and state of the roles, the largest rest of the budget at which nothing was found.

Rows are written in order by ranges; a letter for each row (initial and fault) is all that the search needs.  A conversation within
one range is searched as a whole; in steps of ``BLOCK`` rows if it is longer.  A step is then searched from each state
to each state, and steps are joined by cost, then by order.  A conversation over several ranges is searched
range by range by many tasks and joined in the same way, so that no task searches a hot conversation alone.  ``repaired_turns``
goes over the rows in order and holds the edits of one conversation (a letter each) and a batch of rows.

Defined cases: null roles and texts are one space; null turns come first; rows of one turn are ordered by a digest of role and text; a role without an initial, or with another than s, u or a, can't be kept; a null conversation id is a conversation;
repeated rows are copies; a conversation without rows has an empty audit; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.turns import in_order, range_of
from tabwright.session import materialize

# What the edits cost, in the ASCII order of their initials.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
SPACE, SENTENCE_END = " \t\n\v\f\r", ".!?"
#: States of the roles so far: nothing, a system turn, a user's turn is open, a user's turn has its answer; and the accepting end.
START, SYSTEM, OPEN, ANSWERED, DONE = range(5)
ROLES = "sua"
#: A row's letter: four for each of the initials s, u, a and any other, in each group one for each fault.
FAULTS = ("", "blank", "duplicate", "truncated")
LETTERS = "ABCDEFGHIJKLMNOP"
#: Rows that are searched at once.
BLOCK = 32

TABLE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
TABLE_SQL = "array<struct<start: int, end: int, cost: bigint, audit: string>>"


def least_cost(letter: str) -> int:
    place = LETTERS.index(letter)
    return DELETE if place % 4 else REROLE if place // 4 == 3 else KEEP


def edits(letter: str | None, state: int) -> list[tuple[str, int, bool, int]]:
    """Edits in ASCII order: initial, cost, whether it uses up the row, state afterwards.  Without a row only insertion is left."""
    onward = OPEN if state != OPEN else ANSWERED
    found = [("I", INSERT, False, onward)]
    if letter is None:
        return found
    role, fault = divmod(LETTERS.index(letter), 4)
    found.insert(0, ("D", DELETE, True, state))
    if FAULTS[fault] in ("blank", "duplicate"):
        return found
    more = TRUNCATED if FAULTS[fault] == "truncated" else 0
    expected = 2 if state == OPEN else 1
    if role == 0 and state == START:
        found.append(("K", KEEP + more, True, SYSTEM))
    if role == expected:
        found.append(("K", KEEP + more, True, onward))
    else:
        found.append(("R", REROLE + more, True, onward))
    return found


@lru_cache(maxsize=1 << 14)
def search(letters: str, start: int, end: int) -> tuple[int, str] | None:
    """Cost and initials of the best edits from state ``start`` to ``end``; insertions after the last row only with ``DONE``."""
    n = len(letters)
    left = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + least_cost(letters[i])
    failed: dict[tuple[int, int], int] = {}
    goals = (START, ANSWERED) if end == DONE else (end,)
    path: list[str] = []
    bound, most = left[0], DELETE * n + 2 * INSERT + TRUNCATED
    while bound <= most:
        above = most + 1

        def visit(i: int, state: int, budget: int) -> bool:
            nonlocal above
            if i == n and state in goals:
                return True
            if failed.get((i, state), -1) >= budget:
                return False
            if i < n or end == DONE:
                for initial, cost, used, after in edits(letters[i] if i < n else None, state):
                    rest = budget - cost
                    if rest < left[i + used]:
                        above = min(above, bound + left[i + used] - rest)
                        continue
                    path.append(initial)
                    if visit(i + used, after, rest):
                        return True
                    path.pop()
            failed[i, state] = budget
            return False

        if visit(0, start, bound):
            return bound, "".join(path)
        bound = above
    return None


def joined(letters: str, start: int, closing: bool) -> dict[int, tuple[int, str]]:
    """Best cost and edits from ``start`` to each state (to ``DONE`` if ``closing``), in steps of ``BLOCK`` rows.

    Two sequences to different states differ within the steps so far and neither begins the other, so the order of their beginnings
    decides; their places in that order stand for them."""
    steps = [letters[i : i + BLOCK] for i in range(0, len(letters), BLOCK)] or [""]
    best = {start: (0, 0)}
    history: list[dict[int, tuple[int, str]]] = []
    for k, step in enumerate(steps):
        ends = (DONE,) if closing and k == len(steps) - 1 else (START, SYSTEM, OPEN, ANSWERED)
        found = {}
        for end in ends:
            options = [(cost + way[0], place, way[1], state) for state, (cost, place) in best.items() if (way := search(step, state, end))]
            if options:
                found[end] = min(options)
        places = {end: i for i, end in enumerate(sorted(found, key=lambda e: found[e][1:3]))}
        best = {end: (option[0], places[end]) for end, option in found.items()}
        history.append({end: (option[3], option[2]) for end, option in found.items()})
    result = {}
    for end, (cost, _) in best.items():
        parts, at = [], end
        for step_found in reversed(history):
            at, part = step_found[at]
            parts.append(part)
        result[end] = cost, "".join(reversed(parts))
    return result


def tables(letters: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """For each part of a conversation: the best edits from every state it can begin in to every state it can end in."""
    rows = []
    for text, is_first, is_last in zip(letters.to_pylist(), first.to_pylist(), last.to_pylist()):
        starts = (START,) if is_first else (START, SYSTEM, OPEN, ANSWERED)
        rows.append([{"start": s, "end": e, "cost": c, "audit": a} for s in starts for e, (c, a) in joined(text, s, is_last).items()])
    return pa.array(rows, TABLE)


def best_of(parts: list[list[dict]]) -> dict:
    """Joins the tables of the parts of a conversation, as ``joined`` does with steps."""
    best, history = {START: (0, 0)}, []
    for part in parts:
        found: dict[int, tuple] = {}
        for way in part:
            if way["start"] in best:
                cost, place = best[way["start"]]
                option = (cost + way["cost"], place, way["audit"], way["start"])
                found[way["end"]] = min(found.get(way["end"], option), option)
        places = {end: i for i, end in enumerate(sorted(found, key=lambda e: found[e][1:3]))}
        best = {end: (option[0], places[end]) for end, option in found.items()}
        history.append(found)
    at, audit = DONE, []
    for found in reversed(history):
        audit.append(found[at][2])
        at = found[at][3]
    return {"cost": best[DONE][0], "audit": "".join(reversed(audit))}


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by the remainder of a checksum of conversation and turn."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        part("role").alias("role"),
        part("text").alias("text"),
        (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("damage"),
    ).filter("damage != 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", f"[{SENTENCE_END}]", ""))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.otherwise(F.col("text")).alias("text"))


def lettered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos and letter of each row of an ordered table.  A row is a copy if the first of the rows with its content in
    its conversation stands before it."""
    initial, trimmed = F.substring("role", 1, 1), F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = rows.select(
        "conv_id",
        "turn",
        "pos",
        F.concat_ws(":", "conv_id", F.hex("digest")).alias("same"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("role"),
        F.substring(trimmed, -1, 1).alias("end"),
    )
    repeated = narrow.filter("end != ''").groupBy("same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("rows"))
    held = narrow.join(repeated.filter("rows > 1").drop("rows"), "same", "left")
    fault = F.when(F.col("end") == "", 1).when(F.col("pos") > F.col("first"), 2).when(~F.col("end").isin(*SENTENCE_END), 3).otherwise(0)
    return held.select("conv_id", "turn", "pos", F.substring(F.lit(LETTERS), F.col("role") * 4 + fault + 1, F.lit(1)).alias("letter"))


def gaps_of(rows: DataFrame) -> DataFrame:
    """Turn numbers that are missing between the first and the last of each conversation."""
    each = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)))
    ends = each.groupBy("conv_id").agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.count("turn").alias("turns"))
    return ends.select("conv_id", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps"))


def count_of(pattern: str) -> Column:
    return F.regexp_count("letters", F.lit(pattern)).cast("long")


def plan_repairs(rows: DataFrame) -> DataFrame:
    """One row per conversation of an ordered table: conv_id, blank, duplicate, truncated, illegal (neighbours whose initials are not su,
    ua or au), cost and audit (initials of the edits)."""
    at = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    parts = lettered(rows).groupBy("conv_id", range_of("pos").alias("part")).agg(F.array_join(F.transform(at, lambda x: x.letter), "").alias("letters"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "letters"))).alias("parts"))
    whole = materialize(whole, "turn-letters")
    parted = whole.select("conv_id", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
    spread = parted.select("conv_id", "k", F.col("part.letters").alias("letters"), (F.col("k") == 0).alias("first"), (F.col("k") == F.col("n") - 1).alias("last"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the letters are few bytes but much work
    solved = spread.repartition(tasks, "conv_id", "k").select("conv_id", "k", F.arrow_udf(tables, TABLE_SQL)("letters", "first", "last").alias("ways"))
    ways = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "ways"))).alias("parts"))

    def join(found: pa.Array) -> pa.Array:
        return pa.array([best_of([p["ways"] for p in parts]) for parts in found.to_pylist()], pa.struct([("cost", pa.int64()), ("audit", pa.string())]))

    best = ways.select(F.col("conv_id").alias("its_id"), F.arrow_udf(join, "struct<cost: bigint, audit: string>")("parts").alias("best"))
    letters = F.array_join(F.transform("parts", lambda p: p.letters), "")
    legal = "[A-D](?=[E-H])|[E-H](?=[I-L])|[I-L](?=[E-H])"
    counted = whole.withColumn("letters", letters).select(
        "conv_id",
        *(count_of("[" + LETTERS[k::4] + "]").alias(name) for k, name in enumerate(FAULTS) if name),
        (F.char_length("letters") - 1 - count_of(legal)).alias("illegal"),
    )
    return counted.join(best, F.col("conv_id").eqNullSafe(F.col("its_id"))).select(*counted.columns, "best.cost", "best.audit")


class Applied:
    """Applies the edits of one conversation to its rows, one after the other."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self.turn("")

    def turn(self, text: str) -> tuple[str, str]:
        self.at += 1
        role, self.state = ("assistant", ANSWERED) if self.state == OPEN else ("user", OPEN)
        return role, text

    def rows(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        if edit == "R":
            yield self.turn(text)
            return
        self.at += 1
        if edit == "K":
            self.state = {"s": SYSTEM, "u": OPEN, "a": ANSWERED}[role[0]]
            yield role, text


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), role, text; in order and whole inside each partition.  A conversation
    without turns has one row, with null in place, role and text.  The edits of a conversation come as a row before its first."""
    edits_first = plans.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    stream = rows.select("conv_id", "pos", "role", "text").unionByName(edits_first)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        applied, conv_id, place, out = None, None, 0, []

        def closed() -> None:
            nonlocal place
            for role, text in applied.inserted():
                out.append((conv_id, place, role, text))
                place += 1
            if place == 0:
                out.append((conv_id, None, None, None))

        def made() -> pa.RecordBatch:
            columns = zip(*out) if out else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for key, pos, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text"))):
                if pos < 0:
                    if applied:
                        closed()
                    applied, conv_id, place = Applied(text), key, 0
                    continue
                for turn in applied.rows(role, text):
                    out.append((conv_id, place, *turn))
                    place += 1
            yield made()
            out.clear()
        if applied:
            closed()
            yield made()

    return stream.mapInArrow(run, "conv_id bigint, place bigint, role string, text string")


def line_digests(turns: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of ``role:text``, joined by line feeds, of turns as ``repaired_turns`` gives them, by a running digest."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for key, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if not place:
                    if digest:
                        done.append((at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                if place is not None:
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in done], schema)
        if digest:
            yield pa.RecordBatch.from_pylist([{"conv_id": at, "repaired_sha256": digest.hexdigest()}], schema)

    return turns.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def repair(turns: DataFrame, faulty: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Plans and repaired turns of the conversations in ``turns``.  With ``faulty``, its rows are repaired, and the conversations of
    ``turns`` that have none left there are listed without edits.

    Plans: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  Turns: see ``repaired_turns``."""
    faulty = turns if faulty is None else faulty
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    rows = in_order(faulty.select("conv_id", "turn", space("role"), space("text")), "turns", "role", "text")
    known = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    plans = known
    for found in (gaps_of(rows), plan_repairs(rows)):
        found = found.withColumnRenamed("conv_id", "its_id")
        plans = plans.join(found, F.col("conv_id").eqNullSafe(F.col("its_id")), "left").drop("its_id")
    counts = ["gaps", *filter(None, FAULTS), "illegal", "cost"]
    plans = plans.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"))
    plans = materialize(plans, "turn-plans")
    return plans, repaired_turns(rows, plans)
