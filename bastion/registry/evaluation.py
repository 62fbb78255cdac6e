"""Registered evaluation queries (E1-E9) over benchmark, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.overlap import token_f1
from ..functions.text import norm_role
from ..operators import evaluation as EV
from ..sources.driver_tables import chat_answers, chat_queries, pair_id, sql_pair_id, table, with_sql
from . import duck as D

DOMAINS = ["finance", "hr", "engineering", "marketing"]


def samples(spark, sf):
    """Eval samples from whole conversation turns: question = a user turn, truth = the reply.

    Keywords: all distinct tokens of the question, sorted;
    domain: the role's own department, 'general' for other roles.
    """
    conv = table(spark, sf, "conversations")
    q = chat_queries(conv)
    a = chat_answers(conv)
    j = q.join(a, ["conv_id", "turn"], "inner")
    toks = F.array_distinct(F.filter(F.split("query", r"(?U)\s+"), lambda x: x != ""))
    role = norm_role("role")
    return j.select((pair_id("conv_id", "turn")).alias("sample_id"), "conv_id",
                    F.col("query").alias("question"), F.col("answer").alias("ground_truth"), "role",
                    F.when(role.isin(*DOMAINS), role).otherwise(F.lit("general")).alias("domain"),
                    F.array_sort(toks).alias("contexts_keywords"))


def answers(spark, sf):
    """Retrieved answers: every document is the answer to the questions of the conversation with its id — the
    whole text, with every 500-character window as a context. Where it is not labelled good, retrieval has
    failed: a row without an answer."""
    good = table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id").distinct().withColumn("good", F.lit(True))
    d = table(spark, sf, "documents").join(good, "doc_id", "left").withColumn("text", F.when(F.col("good"), F.col("text")))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - 50), F.lit(450))
    windows = F.transform(starts, lambda i: F.substring(F.col("text"), i, 500))
    return d.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("answer"), windows.alias("contexts"))


SAMPLES_SQL = with_sql("chat_queries", "chat_answers").replace("WITH ", "", 1) + f""",
samples AS (
  SELECT {sql_pair_id('q.conv_id', 'q.turn')} AS sample_id, q.conv_id, q.query AS question, a.answer AS ground_truth, q.role,
         CASE WHEN {D.norm_role('q.role')} IN ('finance', 'hr', 'engineering', 'marketing') THEN {D.norm_role('q.role')}
              ELSE 'general' END AS domain,
         list_sort(list_distinct(list_filter(string_split_regex(q.query, '\\s+'), lambda x: x <> '')))
           AS contexts_keywords
  FROM chat_queries q JOIN chat_answers a ON a.conv_id = q.conv_id AND a.turn = q.turn)"""
ANSWERS_SQL = """answers AS (
  SELECT doc_id AS conv_id, text AS answer,
         list_transform(generate_series(1, greatest(1, length(text) - 50), 450), lambda i: substr(text, i, 500)) AS contexts
  FROM (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN text END AS text FROM documents))"""


def _toks(t):
    return f"list_distinct(list_filter(string_split_regex(lower({t}), '\\s+'), lambda x: x <> ''))"


def _f1(a, b):
    ta, tb = _toks(a), _toks(b)
    inter = f"len(list_intersect({ta}, {tb}))"
    p = f"({inter} / len({ta}))"
    r = f"({inter} / len({tb}))"
    return (f"(CASE WHEN len({ta}) = 0 OR len({tb}) = 0 THEN 0.0::DOUBLE WHEN {inter} = 0 THEN 0.0::DOUBLE "
            f"ELSE 2 * {p} * {r} / ({p} + {r}) END)")


def e1_token_f1(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("a"))
    j = u.join(a, ["conv_id", "turn"], "inner")
    return j.select("conv_id", "turn", F.round(token_f1("q", "a"), 6).alias("f1"))


E1_SQL = f"""SELECT u.conv_id, u.turn, round({_f1('u.text', 'a.text')}, 6) AS f1
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


def e6_mock_retrieve(spark, sf):
    m = EV.mock_retrieve(samples(spark, sf))
    return m.select("sample_id", "mock_answer", F.col("mock_contexts")[0].alias("mock_context"))


def _mock_cols():
    ctx = ("'Question: ' || question || ' Grounded answer: ' || ground_truth || ' Relevant terms: ' || "
           "array_to_string(contexts_keywords, ', ') || '. Department: ' || domain || '.'")
    ans = ("'Question: ' || question || ' Answer: ' || ground_truth || ' Relevant terms: ' || "
           "array_to_string(list_slice(contexts_keywords, 1, 2), ', ') || '.'")
    return ans, ctx


E6_SQL = f"WITH {SAMPLES_SQL}\nSELECT sample_id, {_mock_cols()[0]} AS mock_answer, {_mock_cols()[1]} AS mock_context FROM samples"


def _scored(spark, sf):
    return EV.attach_answers(samples(spark, sf), answers(spark, sf), key="conv_id")


def e7_answer_join(spark, sf):
    s = _scored(spark, sf)
    return s.select("sample_id", "mode", "answer", F.size("contexts").alias("n_contexts"))


JOINED_SQL = f"""WITH {SAMPLES_SQL}, {ANSWERS_SQL},
j AS (SELECT s.*, a.answer AS live_answer, a.contexts AS live_contexts FROM samples s LEFT JOIN answers a USING (conv_id)),
scored AS (SELECT sample_id, question, ground_truth, role, domain,
  CASE WHEN live_answer IS NOT NULL THEN 'live' ELSE 'fallback' END AS mode,
  coalesce(live_answer, {_mock_cols()[0]}) AS answer,
  CASE WHEN live_answer IS NOT NULL THEN live_contexts ELSE [{_mock_cols()[1]}] END AS contexts
  FROM j)"""
E7_SQL = JOINED_SQL + "\nSELECT sample_id, mode, answer, CAST(len(contexts) AS INTEGER) AS n_contexts FROM scored"

PERQ_SQL = JOINED_SQL + f""",
perq AS (SELECT sample_id, question, domain, role, left(answer, 200) AS answer,
  round_even(CASE WHEN len({_toks('answer')}) = 0 THEN 0.0::DOUBLE
    ELSE len(list_intersect({_toks('answer')}, {_toks("array_to_string(contexts, ' ')")})) / len({_toks('answer')}) END, 3) AS faithfulness,
  round_even({_f1('question', 'answer')}, 3) AS answer_relevancy,
  round_even(CASE WHEN len(contexts) = 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform(contexts, lambda c: {_f1('question', 'c')})) / len(contexts) END, 3)
    AS context_precision,
  round_even(CASE WHEN len(contexts) = 0 THEN 0.0::DOUBLE ELSE {_f1('ground_truth', "array_to_string(contexts, ' ')")} END, 3) AS context_recall
  FROM scored)"""


def e8_per_question(spark, sf):
    return EV.per_question(_scored(spark, sf))


E8_SQL = PERQ_SQL + "\nSELECT * FROM perq"


def e9_summary(spark, sf):
    return EV.summary(EV.per_question(_scored(spark, sf)))


def _mean3(m):
    s = f"sum(CAST(round({m} * 1000) AS BIGINT))"
    n = f"count({m})"
    q = f"({s} // {n})"
    rem2 = f"(({s} - {q} * {n}) * 2)"
    return (f"(CASE WHEN {rem2} > {n} THEN {q} + 1 WHEN {rem2} = {n} AND {q} % 2 = 1 THEN {q} + 1 ELSE {q} END) "
            f"/ 1000.0::DOUBLE")


def _e9_sql(by=None):
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    ms = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]
    cols = ", ".join(f"{_mean3(m)} AS avg_{m}" for m in ms)
    least = ", ".join(_mean3(m) for m in ms)
    return PERQ_SQL + f"""
SELECT {g}count(*) AS total_questions, {cols}, 0.3::DOUBLE AS threshold, least({least}) >= 0.3 AS passed
FROM perq{grp}"""


def e9_summary_by_domain(spark, sf):
    return EV.summary(EV.per_question(_scored(spark, sf)), by=["domain"])


QUERIES = {
    "e1_token_f1": e1_token_f1,
    "e6_mock_retrieve": e6_mock_retrieve,
    "e7_answer_join": e7_answer_join,
    "e8_per_question": e8_per_question,
    "e9_summary": e9_summary,
    "e9_summary_by_domain": e9_summary_by_domain,
}
ORACLE = {
    "e1_token_f1": E1_SQL,
    "e6_mock_retrieve": E6_SQL,
    "e7_answer_join": E7_SQL,
    "e8_per_question": E8_SQL,
    "e9_summary": _e9_sql(),
    "e9_summary_by_domain": _e9_sql("domain"),
}


def p3_eval_report(spark, sf):
    """The JSON-report row (S10 shape)."""
    rep = EV.report(EV.per_question(_scored(spark, sf)), mode="live")
    return rep.select("total_questions", "avg_faithfulness", "avg_answer_relevancy", "avg_context_precision",
                      "avg_context_recall", "threshold", "passed", "mode")


QUERIES["p3_eval_report"] = p3_eval_report
ORACLE["p3_eval_report"] = _e9_sql().replace("FROM perq", ", 'live' AS mode FROM perq")
