import hashlib
import random
from collections import defaultdict

from tabwright.llm import chat_format

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block int, task string"


def plain(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        turns[conv_id].append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv_id, found in turns.items():
        found.sort()
        loss = "".join(text for _, role, text in found if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, role, text in found)
        out[conv_id] = (len(found), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    blocks = chat_format.format_conversations(frame)
    got = chat_format.read_back(blocks).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}, blocks, {r.conv_id: r.formatted_chars for r in got}


def test_control_strings_nulls_and_ties(spark):
    rng = random.Random(3)
    parts = ["<|turn|>", "<|text|>", "<|end|>\n", "\\", "<", "|", "<\\|", "é😀", "assistant", "\n", " ok"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|text|>\\"]), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    rows += [(None, None, "assistant", None), (None, 2, "assistant", "x"), (50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (50, None, None, "")]
    rows += [(51, 0, "assistant", "long <|turn|> " * 200_000)]
    got, _, _ = read(spark, rows)
    assert got == plain(rows)
    assert read(spark, [])[0] == {}


def test_a_long_conversation_comes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK_BYTES", 2000)
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} " * 5) for t in range(3000)] + [(2, 0, "user", "a")]
    got, blocks, chars = read(spark, rows)
    assert got == plain(rows)
    parts = blocks.filter("conv_id = 1").orderBy("task", "block").collect()
    assert len(parts) > 20 and len({p.task for p in parts}) > 1
    text = "".join(p.formatted for p in parts)
    assert len(text) == chars[1] and text.count("<|turn|>") == 3000
    for part in parts[:5]:
        data = part.formatted.encode()
        assert all(data[s.start : s.end].startswith(b"turn ") for s in part.loss_spans)


def test_thousands_of_rows_of_one_turn_keep_their_order_over_tasks(spark):
    rng = random.Random(5)
    roles = ["assistant", "user", "system", None]
    rows = [(1, t, rng.choice(roles), f"{rng.choice(['a', 'é', '日', '😀', ''])} {rng.randrange(3000)}") for t in (None, 4) for _ in range(4000)]
    rows += [(None, 0, "assistant", "same beginning " * 20 + str(rng.randrange(500))) for _ in range(2000)]
    rng.shuffle(rows)
    got, blocks, _ = read(spark, rows)
    assert got == plain(rows)
    assert blocks.filter("conv_id = 1").select("task").distinct().count() > 3
