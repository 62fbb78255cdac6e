"""V1: the native fold gives the windows of the plain splitter."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from bastion.operators import ingest as I


def native(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in I.boundary_chunks(df, **kw).collect():
        out.setdefault(r.doc_id, []).append((r.pos, r.chunk_text, r.chunk_id))
    return [[t for _, t, _ in sorted(out.get(k, []))] for k in range(len(texts))]


def test_texts_of_many_shapes(spark):
    rng = random.Random(1)
    marks = ["\n\n", "\n", ". ", " ", "x", "é", "word", "  ", "\t", "\r\n", "😀"]
    texts = ["".join(rng.choice(marks[:rng.randrange(3, len(marks) + 1)]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    texts += ["", None, " \n ", "a" * 1234, "b" * 500, "c" * 501, "para one. " * 80 + "\n\n" + "line\n" * 200]
    assert native(spark, texts) == [I.split_text(t or "") for t in texts]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab .\n", max_size=90), min_size=1, max_size=30))
def test_small_windows_need_every_step(spark, texts):
    """Windows of 12 with an overlap of 5: many windows end at a lesser break just after the one before."""
    assert native(spark, texts, size=12, overlap=5) == [I.split_text(t, 12, 5) for t in texts]


def test_a_long_text_over_many_blocks(spark):
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "é", "x" * 30, ". ", "\n", "\n\n"]) for _ in range(60_000))
    assert native(spark, [text]) == [I.split_text(text)]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, source string")
    plan = I.boundary_chunks(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Exchange" not in plan
    assert I.boundary_chunks(df).columns == ["doc_id", "source", "pos", "chunk_text", "chunk_id"]
