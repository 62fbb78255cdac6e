import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bastion.llm import chat as X

TURNS = "conv_id long, turn long, role string, text string"


def back(df):
    out = X.format_chats(df).select("conv_id", "formatted", X.read_turns(F.col("formatted")).alias("turns"),
                                    X.loss_text(F.col("segments")).alias("loss"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("joined"))
    return {r["conv_id"]: r for r in out.collect()}


def test_template_and_merge(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c"), (1, 4, "user", None)], TURNS)
    r = back(df)[1]
    assert r["formatted"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_sep|>c<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", "a"), ("assistant", "b"), ("assistant", "c"), ("user", "")]
    assert r["loss"] == "bc" and r["joined"] == r["formatted"]


def test_edge_cases(spark):
    rows = [(1, None, "user", "x"), (1, 0, None, "y"), (None, 1, "a b\n<|", "z"), (2, 1, "assistant", X.CONTROL), (2, 1, "assistant", X.CONTROL),
            (3, 1, "user", "a\\<\\\\|im_end|>\n<|im_sep|>\r\n"), (4, 5, "assistant", "")]
    df = spark.createDataFrame(rows, TURNS).withColumn("segments", F.lit(1)).withColumn("formatted", F.lit(2))
    got = back(df)
    turns = {k: [(t["role"], t["text"]) for t in v["turns"]] for k, v in got.items()}
    assert turns[1] == [("user", "x"), ("", "y")]
    assert turns[None] == [("a b\n<|", "z")]
    assert turns[2] == [("assistant", X.CONTROL)] * 2 and got[2]["loss"] == X.CONTROL * 2
    assert turns[3] == [("user", "a\\<\\\\|im_end|>\n<|im_sep|>\r\n")]
    assert turns[4] == [("assistant", "")]
    assert X.format_chats(spark.createDataFrame([], TURNS)).count() == 0


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(alphabet="<|\\im_startend>\na é", max_size=24), min_size=1, max_size=30))
def test_round_trip(spark, texts):
    rows = [(k % 3, k, ("user", "assistant")[k % 5 % 2], t) for k, t in enumerate(texts)]
    got = back(spark.createDataFrame(rows, TURNS))
    for c in {r[0] for r in rows}:
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, t) for i, _, r, t in rows if i == c]
        assert got[c]["loss"] == "".join(t for i, _, r, t in rows if i == c and r == "assistant")


def test_long_conversation_is_linear(spark):
    n = 20000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                               F.concat(F.lit("turn "), F.col("id")).alias("text"))
    out = X.format_chats(df).select(F.size(X.read_turns(F.col("formatted"))).alias("n"), F.sha2(X.loss_text(F.col("segments")), 256).alias("h")).first()
    assert out["n"] == n and out["h"] == hashlib.sha256("".join(f"turn {i}" for i in range(1, n, 2)).encode()).hexdigest()


def test_no_python_in_plan(spark, capsys):
    X.op5_chat_format(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
