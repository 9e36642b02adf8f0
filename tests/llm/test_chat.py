"""Chat formatting: placeholders, attachments, escaping, and the mask against a plain version."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lamella.llm.chat import PARTS, Chat, format_conversations, read_back, text_parts

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<image>", "<audio>", "<document>"]
ROWS = f"conv_id long, turn long, role string, parts {PARTS}, text string, formatted string"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def formatted(spark, rows, how=Chat()):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS)
    return {r.conv_id: r for r in read_back(format_conversations(df, how)).collect()}


def test_parts_become_placeholders_attachments_and_tokens(spark):
    parts = [
        part("text", "see "), part("image", ref="a.png", width=57, height=28), part(None, " and "),
        part("audio", ref="b.wav", seconds=1.01), part("document", ref="c.pdf", pages=3), part("image", ref="d.png"), part("video", "?"),
    ]
    got = formatted(spark, [(1, 0, "user", parts), (1, 1, "assistant", [part("text", "ok")])])[1]
    assert got.texts == ["see <image> and <audio><document><image>?", "ok"]
    assert [tuple(a) for a in got.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 26), ("document", "c.pdf", 3072), ("image", "d.png", 0)]
    assert got.media_tokens == 3 + 26 + 3072
    assert got.formatted == "<s>[INST]user[/INST]see <image> and <audio><document><image>?</s><s>[INST]assistant[/INST]ok</s>"
    assert got.learned_texts == ["ok"]


def test_control_strings_come_back_from_any_text(spark):
    pick = random.Random(3)
    pieces = [*CONTROLS, "\\", "<", "[", "s>", "/s>", "é", "😀", "\n", "$1", "INST]", " ", ""]
    wanted, rows = {}, []
    for conv in range(40):
        turns = []
        for turn in range(pick.randrange(1, 6)):
            text = "".join(pick.choice(pieces) for _ in range(pick.randrange(12)))
            role = pick.choice(["user", "assistant", "system", "</s>", "[/INST]\\", ""])
            turns.append((role, text))
            rows.append((conv, turn, role, [part("text", text)]))
        wanted[conv] = turns
    pick.shuffle(rows)
    got = formatted(spark, rows)
    for conv, turns in wanted.items():
        row = got[conv]
        assert list(zip(row.roles, row.texts)) == turns
        assert row.learned_texts == [text for role, text in turns if role == "assistant"]
        bodies = [row.formatted[t.body : t.end] for t in row.turns]
        assert all(c not in b for b in bodies for c in CONTROLS)
        assert row.formatted == "".join(row.formatted[t.start : t.end] + "</s>" for t in row.turns)


def test_nulls_repeated_rows_many_turns_and_nothing(spark):
    rows = [(None, 0, "user", None), (None, None, None, [part("text")]), (2, 1, "assistant", [part("text", "x")])]
    rows += [(2, 1, "assistant", [part("text", "x")]), (3, 0, "assistant", [part("text", "<s>" * 400_000)])]
    rows += [(4, n, "assistant" if n % 2 else "user", [part("text", str(n))]) for n in range(3000)]
    got = formatted(spark, rows)
    assert (got[None].roles, got[None].texts) == (["", "user"], ["", ""])
    assert got[2].learned_texts == ["x", "x"]
    assert got[3].learned_texts == ["<s>" * 400_000]
    assert got[4].learned_texts == [str(n) for n in range(1, 3000, 2)]
    assert formatted(spark, rows[:0]) == {}


def test_given_conversations_against_plain_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    wanted = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.turn)):
        wanted.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    out = read_back(format_conversations(df.withColumn("parts", text_parts(F.col("text"))))).collect()
    assert {r.conv_id: list(zip(r.roles, r.texts)) for r in out} == wanted
