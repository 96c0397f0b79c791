import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tabwright.llm import conversation_repair as cr
from tabwright.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos int, letter string, audit string"
SPACES = " \t\n\v\f\r"


def plain_damage(rows):
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        damage = zlib.crc32(key.encode()) % 20
        if damage == 1:
            text = ""
        if damage == 2:
            text = re.sub("[.!?]", "", text)
        if damage == 4:
            role = "user"
        yield from [(conv_id, turn, role, text)] * {0: 0, 3: 2}.get(damage, 1)


def plain_repair(rows):
    """Counts, cost, audit and repaired turns of one conversation: all ways to each state after each row, the cheapest and least one kept."""
    counts, faults, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
    for role, text in rows:
        bare = text.strip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    best = {"": (0, "", [])}  # by the last two initials, "s" or ""

    def onward(state):
        return "u" if state in ("", "s", "a") else "a"

    def put(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def with_insertions(table):
        out = dict(table)
        for _ in range(2):
            for state, (cost, audit, turns) in list(out.items()):
                put(out, onward(state), (cost + 5, audit + "I", [*turns, ({"u": "user", "a": "assistant"}[onward(state)], "")]))
        return out

    for (role, text), fault in zip(rows, faults):
        table = {}
        for state, (cost, audit, turns) in with_insertions(best).items():
            put(table, state, (cost + 2, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more, nxt = 5 * (fault == "truncated"), onward(state)
            if role[:1] == nxt or (role[:1] == "s" and state == ""):
                put(table, role[0], (cost + more, audit + "K", [*turns, (role, text)]))
            put(table, nxt, (cost + 1 + more, audit + "R", [*turns, ({"u": "user", "a": "assistant"}[nxt], text)]))
        best = table
    cost, audit, turns = min((w for s, w in with_insertions(best).items() if s in ("", "a")), key=lambda w: w[:2])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (*counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def plain(original, rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        turns[conv_id].append((conv_id, turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv_id in {r[0] for r in original}:
        own = sorted(turns[conv_id], key=lambda r: (-1 if r[1] is None else r[1]))
        known = {r[1] for r in own if r[1] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[conv_id] = (gaps, *plain_repair([r[2:] for r in own]))
    return out


def got(spark, original, rows):
    make = lambda rows: spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    plans, repaired = cr.repair(make(original), None if rows is None else make(rows))
    digests = {r.conv_id: r.repaired_sha256 for r in cr.line_digests(repaired).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[r.conv_id]) for r in plans.collect()}, repaired


def random_rows(rng, convs, longest):
    for conv_id in range(convs):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", ""])
            yield conv_id, turn, role, rng.choice(["", " \n", "a.", "b!", "c", "d? ", f"{turn}."])


def test_repairs_equal_all_ways(spark):
    rows = list(random_rows(random.Random(2), 400, 12))
    assert got(spark, rows, None)[0] == plain(rows, rows)


def test_long_conversations_over_many_ranges(spark):
    rows = list(random_rows(random.Random(3), 3, 400)) + [(9, t, "assistant", f"{t}.") for t in range(300)]
    found, repaired = got(spark, rows, None)
    assert found == plain(rows, rows)
    turns = sorted((r.place, r.role) for r in repaired.filter("conv_id = 9").collect())
    assert [p for p, _ in turns] == list(range(300)) and re.fullmatch("(ua)+", "".join(role[0] for _, role in turns))


@pytest.mark.parametrize("seed", range(3))
def test_steps_and_parts_equal_the_whole(seed, monkeypatch):
    rng = random.Random(seed)
    for _ in range(60):
        letters = "".join(rng.choices(cr.LETTERS, [1, 1, 1, 1, 9, 2, 2, 3, 9, 2, 2, 3, 1, 1, 1, 1], k=rng.randint(0, 24)))
        want = cr.search(letters, cr.START, cr.DONE)
        cut = rng.randint(0, len(letters))
        parts = [
            [{"start": s, "end": e, "cost": c, "audit": a} for s in range(4) for e, (c, a) in cr.joined(part, s, last).items()]
            for part, last in ((letters[:cut], False), (letters[cut:], True))
        ]
        assert cr.best_of(parts) == {"cost": want[0], "audit": want[1]}
        with monkeypatch.context() as patch:
            patch.setattr(cr, "BLOCK", 3)
            assert cr.joined(letters, cr.START, True)[cr.DONE] == want


def test_search_by_enumeration():
    rng = random.Random(5)
    for _ in range(40):
        letters = "".join(rng.choices(cr.LETTERS, k=rng.randint(0, 4)))
        ways = []

        def walk(i, state, cost, path):
            if i == len(letters) and state in (cr.START, cr.ANSWERED):
                ways.append((cost, path))
            if len(path) < len(letters) + 3:
                for edit, price, used, after in cr.edits(letters[i] if i < len(letters) else None, state):
                    walk(i + used, after, cost + price, path + edit)

        walk(0, cr.START, 0, "")
        assert cr.search(letters, cr.START, cr.DONE) == min(ways)


def test_query_over_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows, list(plain_damage(rows)))
    found = QUERIES["op11_repair_astar"](spark, "/root/testdata/sf0.01").collect()
    assert {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in found} == want
    assert len(found) == len(want)


def test_defined_cases(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "q?"), (None, 2, "assistant", "a."),
        (1, 3, "user", "long text. " * 200_000), (1, 3, "user", "long text. " * 200_000), (1, None, "system", "s."), (1, 9, "assistant", "é日本。."),
        (2, None, "user", ""), (3, 5, "", "no role."), (4, 0, "user", "broken"),
    ]
    assert got(spark, rows, None)[0] == plain(rows, rows)
    gone, _ = got(spark, rows, rows[:1])
    assert gone[4] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and set(gone) == {None, 1, 2, 3, 4}
    assert got(spark, [], None)[0] == {}
    everything = [(c, t, r, x) for c, t, r, x in rows]
    assert {r for r in plain_damage(everything)} == {tuple(r) for r in cr.damaged(spark.createDataFrame(everything, "conv_id bigint, turn bigint, role string, text string")).collect()}
