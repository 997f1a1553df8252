from __future__ import annotations

import random

from pyspark.sql import functions as F

from siftmark.llm import chat_format as C


def test_round_trip_of_control_strings(spark):
    rnd = random.Random(4)
    parts = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "\\", "<\\/s>", "[\\\\INST]", " ", "\n", "a", "é\U0001F600", "<", "[", "]", "$1", "s>"]
    roles = ["user", "assistant", "system", "tool", "", None, "</s>", "[INST] user"]
    rows = [(k % 150, k // 150, rnd.choice(roles), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8))), "x") for k in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    out = C.format_conversations(df).collect()
    assert len(out) == 150 and all(r["identical"] for r in out)
    source = {}
    for c, t, role, text, _ in rows:
        source.setdefault(c, []).append((t, role or "", text))
    for r in out:
        assert [(t["role"], t["text"]) for t in r["parsed"]] == [x[1:] for x in sorted(source[r["conv_id"]])]


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "plain <b> [x]"), (2, 0, "user", "say </s> now"), (3, 0, "assistant", "<\\/s>")]
    got = {r["conv_id"]: r for r in C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["formatted"] == "[INST] plain <b> [x] [/INST]" and got[1]["escape_round"] == 0
    assert got[2]["formatted"] == "[INST] say <\\/s> now [/INST]" and got[2]["escape_round"] == 1
    assert got[3]["formatted"] == "<s> <\\\\/s> </s>"


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, None, "user", "b"), (1, None, "user", None), (1, 0, None, "x" * 200_000), (None, 1, "user", "lost"), (1, 0, "user", "same"), (1, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"parsed": F.lit(1), "items": F.lit(2)})
    got = {r["conv_id"]: r for r in C.format_conversations(df).collect()}
    assert got[1]["n_turns"] == 5 and got[None]["n_turns"] == 1 and all(r["identical"] for r in got.values())
    assert [t["text"] for t in got[1]["parsed"]][:2] == ["", "b"]
    assert C.format_conversations(df.filter("false")).count() == 0


def test_the_planted_conversation(spark, small):
    r = C.op1_chat_format(spark, small).filter("conv_id = -7").first()
    assert r["n_turns"] == 2 and r["loss_chars"] == len("</s>[INST] ok [/INST]")
