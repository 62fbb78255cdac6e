"""The ordered keyword list as one pattern."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bastion.functions import libraries as L
from bastion.functions.guards import any_keyword, first_keyword, scope_check, trie_pattern


def first(text, keywords):
    return next((k for k in keywords if k in text), None)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab.(é ", min_size=1, max_size=4), min_size=1, max_size=9, unique=True), st.text("ab.(é ", max_size=14))
def test_pattern_finds_the_first_of_the_list(keywords, text):
    found = {m.group(1) for m in re.finditer(f"(?=({trie_pattern(keywords)}))", text)}
    assert found <= set(keywords)
    assert min((keywords.index(k) for k in found), default=None) == (keywords.index(f) if (f := first(text, keywords)) else None)
    assert bool(re.search(trie_pattern(keywords), text)) == (first(text, keywords) is not None)


def test_columns_equal_a_scan_per_keyword(spark):
    lists = [L.in_scope_keywords("Acme"), L.COMPLEX_KEYWORDS, ["bc", "b", "abcd", "abc"], ["b", "bc"]]
    words = sorted({w for k in lists for x in k for w in (x, x[:-1], x[1:], x + "s")})
    texts = [" ".join(words[i::7]) for i in range(7)] + [a + b for a, b in zip(words, words[3:])] + ["", None, "nothing here", "xabcdx"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for keywords in lists:
        got = df.select("t", first_keyword(F.col("t"), keywords).alias("k"), any_keyword(F.col("t"), keywords).alias("any")).collect()
        for r in got:
            want = None if r.t is None else first(r.t, keywords)
            assert r.k == want and r.any == (None if r.t is None else want is not None)


def test_one_scan_in_the_plan(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(scope_check("t").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan and "regexp_extract_all" in plan
