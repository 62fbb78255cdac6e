"""A1-A14 and E1-E9 fixtures (FIXTURES.md §2 monitoring, feedback, evaluation)."""

import datetime as dt

from pyspark.sql import functions as F

from bastion.functions.overlap import answer_relevancy, context_precision, context_recall, faithfulness, token_f1
from bastion.operators import evaluation as EV
from bastion.operators import feedback as FB
from bastion.operators import monitoring as M

SCHEMA = ("id long, ts timestamp_ntz, username string, role string, model_used string, complexity string, "
          "latency_ms double, tokens_used int, cost_usd double, cache_hit boolean, guardrail_triggered boolean, "
          "guardrail_reason string")
T0 = dt.datetime(2024, 1, 1)


def _metrics(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_empty_summary_and_kpis(spark):
    m = _metrics(spark, [])
    a = M.metrics_summary(m, 24, as_of=T0).first()
    assert a.total_queries == 0 and a.avg_latency_ms is None and a.total_cost_usd is None
    k = M.kpi_row(m, 24, as_of=T0).first()
    assert tuple(k) == (0, 0.0, 0.0, 0, 0, 0.0)


def test_trend_gap_fill(spark):
    rows = [(1, T0 + dt.timedelta(minutes=2), "u", "hr", "m", "simple", 10.0, 5, 0.001, False, False, ""),
            (2, T0 + dt.timedelta(minutes=19), "u", "hr", "m", "simple", 30.0, 5, 0.002, True, False, "")]
    m = _metrics(spark, rows)
    lat = M.latency_trend(m, 24, as_of=T0 + dt.timedelta(hours=1)).orderBy("bucket").collect()
    cost = M.cost_trend(m, 24, as_of=T0 + dt.timedelta(hours=1)).orderBy("bucket").collect()
    assert [r.avg_latency_ms for r in lat] == [10.0, None, None, 30.0]
    assert [r.total_cost_usd for r in cost] == [0.001, 0.0, 0.0, 0.002]


def test_hours_selector_matches_summary(spark):
    rows = [(i, T0 - dt.timedelta(hours=h), f"u{i % 3}", "hr", "m", "simple", float(i), i, 0.001 * i, i % 2 == 0,
             i % 5 == 0, "") for i, h in enumerate([0.5, 2, 5, 7, 13, 30, 60, 100, 200])]
    m = _metrics(spark, rows)
    sel = {r.hours: r for r in M.hours_selector(m, as_of=T0).collect()}
    for h in [1, 6, 12, 24, 48, 168]:
        one = M.metrics_summary(m, h, as_of=T0).first()
        assert sel[h].total_queries == one.total_queries and sel[h].unique_users == one.unique_users
        assert sel[h].total_tokens == one.total_tokens


def test_value_counts_and_recent(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i), "u", "hr", None if i == 0 else "m" + str(i % 2), "simple", 1.0, 1,
             0.0, False, True, "x") for i in range(60)]
    m = _metrics(spark, rows)
    vc = M.value_counts(m, "model_used", as_of=T0 + dt.timedelta(hours=2)).collect()
    assert [(r.model_used, r.queries) for r in vc] == [("m1", 30), ("m0", 29)]
    ev = M.recent_events(m.withColumn("event_type", F.lit("INJECTION")).withColumn("reason", F.lit("r")),
                         24, as_of=T0 + dt.timedelta(hours=2))
    assert ev.count() == 50


def test_feedback(spark):
    s = "chat_id string, username string, role string, rating int, comment string, ts timestamp_ntz, id long"
    req = spark.createDataFrame([("c1", "a", "hr", 1, "x" * 600, T0, 1), ("c2", "a", "hr", 1, "", T0, 2),
                                 ("c3", "a", "hr", -1, None, T0, 3), ("c4", "a", "hr", 0, "", T0, 4),
                                 ("c5", "a", "hr", 2, "", T0, 5)], s)
    valid, rej = FB.intake(req)
    assert valid.count() == 3 and rej.count() == 2
    assert valid.where(F.col("chat_id") == "c1").first().comment == "x" * 500
    sm = FB.summary(valid, 24, as_of=T0).first()
    assert (sm.total_ratings, sm.thumbs_up, sm.thumbs_down, sm.satisfaction_pct) == (3, 2, 1, 66.7)
    none = FB.summary(valid.limit(0), 24, as_of=T0).first()
    assert (none.total_ratings, none.thumbs_up, none.thumbs_down, none.satisfaction_pct) == (0, 0, 0, None)
    chats = spark.createDataFrame([("c1", False), ("c2", True), ("c3", False)], "chat_id string, guardrail_triggered boolean")
    twice = valid.unionByName(valid.where(F.col("chat_id") == "c1").withColumn("id", F.lit(9)))
    assert sorted(r.chat_id for r in FB.eligible(twice, chats).collect()) == ["c1", "c3"]


def test_overlap_metrics(spark):
    df = spark.createDataFrame([("a b", "a c", "policy? x", ["a c"], ["policy x"], "", [])],
                               "ans string, ctx string, q string, c1 array<string>, c2 array<string>, e string, "
                               "none array<string>")
    r = df.select(faithfulness("ans", "ctx").alias("f"), F.round(token_f1("ans", "ctx"), 3).alias("f1"),
                  faithfulness("e", "ctx").alias("fe"), context_precision("q", "none").alias("p0"),
                  context_recall("q", "none").alias("r0"), answer_relevancy("q", F.lit("policy x")).alias("punct"),
                  context_precision("ans", "c1").alias("p1")).first()
    assert (r.f, r.f1, r.fe, r.p0, r.r0, r.p1) == (0.5, 0.5, 0.0, 0.0, 0.0, 0.5)
    assert r.punct == 0.5  # 'policy?' != 'policy'


def test_gate_passes_at_equality(spark):
    per_q = spark.createDataFrame([(1, "q", "d", "r", "a", 0.3, 0.3, 0.3, 0.3)],
                                  "sample_id long, question string, domain string, role string, answer string, "
                                  "faithfulness double, answer_relevancy double, context_precision double, "
                                  "context_recall double")
    s = EV.summary(per_q, 0.3).first()
    assert s.passed and s.avg_faithfulness == 0.3
    rep = EV.report(per_q, 0.3).first()
    assert rep.passed and rep.total_questions == 1 and rep.mode == "dry_run"


def test_mock_retrieve_template(spark):
    s = spark.createDataFrame([(1, "What is X?", "X is Y.", "hr", ["k1", "k2", "k3"], "hr")],
                              "sample_id long, question string, ground_truth string, role string, "
                              "contexts_keywords array<string>, domain string")
    m = EV.attach_answers(s, None).first()
    assert m.answer == "Question: What is X? Answer: X is Y. Relevant terms: k1, k2."
    assert m.contexts == ["Question: What is X? Grounded answer: X is Y. Relevant terms: k1, k2, k3. Department: hr."]


def test_hours_selector_ignores_null_users_like_the_summary(spark):
    import datetime as dt
    from bastion.operators.monitoring import hours_selector, metrics_summary
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t0, None, 1.0, 0.0, 1, False, False), (2, t0, "u", 1.0, 0.0, 1, False, False)],
                               "id long, ts timestamp_ntz, username string, latency_ms double, cost_usd double, tokens_used int, "
                               "cache_hit boolean, guardrail_triggered boolean")
    assert metrics_summary(df, 24, as_of=t0).first()["unique_users"] == 1
    assert {r.unique_users for r in hours_selector(df, as_of=t0).collect()} == {1}
