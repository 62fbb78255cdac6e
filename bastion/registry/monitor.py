"""Registered monitoring and feedback queries (A1-A14) over events-as-metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import libraries as L
from ..operators import feedback as FB
from ..operators import monitoring as M
from ..operators import rollups as RU
from ..sources.driver_tables import feedback_requests, query_metrics, table, with_sql
from ..session import scratch
from ..streaming import stateful as ST
from . import duck as D

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DUCK_TS = "'%Y-%m-%d %H:%M:%S.%f'"


def _qm(spark, sf):
    return query_metrics(table(spark, sf, "events"))


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


AS_OF = "(SELECT max(ts) FROM events)"


def _win(h=24, col="ts"):
    return f"{col} >= {AS_OF} - INTERVAL {h} HOUR"


def a1_metrics_summary(spark, sf):
    s = M.metrics_summary(_qm(spark, sf), 24)
    return s.select("total_queries", _r("avg_latency_ms"), _r("total_cost_usd"), "total_tokens", "cache_hits",
                    "guardrail_blocks", "unique_users")


A1_SQL = with_sql("query_metrics") + f"""SELECT count(*) AS total_queries, round(avg(latency_ms), 6) AS avg_latency_ms,
  round(sum(cost_usd), 6) AS total_cost_usd, CAST(sum(tokens_used) AS BIGINT) AS total_tokens,
  CAST(sum(CASE WHEN cache_hit THEN 1 ELSE 0 END) AS BIGINT) AS cache_hits,
  CAST(sum(CASE WHEN guardrail_triggered THEN 1 ELSE 0 END) AS BIGINT) AS guardrail_blocks,
  count(DISTINCT username) AS unique_users
FROM query_metrics WHERE {_win()}"""


def _valid_feedback(spark, sf):
    valid, _ = FB.intake(feedback_requests(table(spark, sf, "events")))
    return valid


def a2_feedback_summary(spark, sf):
    fb = _valid_feedback(spark, sf)
    return FB.summary(fb, 24, as_of=M.latest_ts(table(spark, sf, "events")))


A2_SQL = with_sql("feedback_requests") + f"""SELECT count(*) AS total_ratings,
  CAST(coalesce(sum(CASE WHEN rating = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS thumbs_up,
  CAST(coalesce(sum(CASE WHEN rating = -1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS thumbs_down,
  round(100.0::DOUBLE * coalesce(sum(CASE WHEN rating = 1 THEN 1 ELSE 0 END), 0) / nullif(count(*), 0), 1) AS satisfaction_pct
FROM feedback_requests WHERE rating IN (1, -1) AND {_win()}"""


def a3_recent_metrics(spark, sf):
    r = M.recent_metrics(_qm(spark, sf), 24)
    return r.withColumn("ts", F.date_format("ts", TS_FMT))


A3_SQL = with_sql("query_metrics") + f"""SELECT * REPLACE (strftime(ts, {DUCK_TS}) AS ts) FROM query_metrics
WHERE {_win()} ORDER BY ts DESC"""


def a4_hours_selector(spark, sf):
    h = M.hours_selector(_qm(spark, sf))
    return h.select("hours", "total_queries", _r("avg_latency_ms"), _r("total_cost_usd"), "total_tokens",
                    "cache_hits", "guardrail_blocks", "unique_users")


A4_SQL = with_sql("query_metrics") + f"""SELECT v.hours AS hours, count(q.id) AS total_queries, round(avg(q.latency_ms), 6) AS avg_latency_ms,
  round(sum(q.cost_usd), 6) AS total_cost_usd, CAST(sum(q.tokens_used) AS BIGINT) AS total_tokens,
  CAST(sum(CASE WHEN q.cache_hit THEN 1 ELSE 0 END) AS BIGINT) AS cache_hits,
  CAST(sum(CASE WHEN q.guardrail_triggered THEN 1 ELSE 0 END) AS BIGINT) AS guardrail_blocks,
  count(DISTINCT q.username) AS unique_users
FROM {D.values([(h,) for h in L.DASHBOARD_HOURS], ['hours'])}
LEFT JOIN query_metrics q ON q.ts >= {AS_OF} - v.hours * INTERVAL 1 HOUR
GROUP BY v.hours"""


def a5_feedback_valid(spark, sf):
    v = _valid_feedback(spark, sf)
    return v.select("id", "chat_id", "username", "rating", F.length("comment").alias("comment_len"))


A5V_SQL = with_sql("feedback_requests") + """SELECT id, chat_id, username, rating, CAST(length(left(comment, 500)) AS INTEGER) AS comment_len
FROM feedback_requests WHERE rating IN (1, -1)"""


def a5_feedback_rejects(spark, sf):
    _, rej = FB.intake(feedback_requests(table(spark, sf, "events")))
    return rej.select("id", "rating", "reject_reason")


A5R_SQL = with_sql("feedback_requests") + """SELECT id, rating, 'rating must be +1 or -1, got ' || CAST(rating AS VARCHAR) AS reject_reason
FROM feedback_requests WHERE rating NOT IN (1, -1)"""


def a6_feedback_eligible(spark, sf):
    chats = _qm(spark, sf).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chat_id"),
                                  "guardrail_triggered")
    e = FB.eligible(_valid_feedback(spark, sf), chats)
    return e.select("chat_id", "username", "rating", F.date_format("ts", TS_FMT).alias("ts"))


A6_SQL = with_sql("query_metrics", "feedback_requests") + f"""
, ok AS (SELECT 'c' || CAST(id AS VARCHAR) AS chat_id FROM query_metrics WHERE NOT guardrail_triggered),
fb AS (SELECT * FROM feedback_requests WHERE rating IN (1, -1) AND chat_id IN (SELECT chat_id FROM ok)),
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id, username ORDER BY ts, id) AS rn FROM fb)
SELECT chat_id, username, rating, strftime(ts, {DUCK_TS}) AS ts FROM r WHERE rn = 1"""


def _guard_events(spark, sf):
    q = _qm(spark, sf).where(F.col("guardrail_triggered"))
    return q.select("id", "ts", "username", "role", F.lit("INJECTION").alias("event_type"),
                    F.col("guardrail_reason").alias("reason"))


def a7_recent_guardrail_events(spark, sf):
    ev = M.recent_events(_guard_events(spark, sf), 24, as_of=M.latest_ts(table(spark, sf, "events")))
    return ev.withColumn("ts", F.date_format("ts", TS_FMT))


A7_SQL = with_sql("query_metrics") + f"""SELECT strftime(ts, {DUCK_TS}) AS ts, username, role, 'INJECTION' AS event_type, guardrail_reason AS reason
FROM query_metrics WHERE guardrail_triggered AND {_win()} ORDER BY query_metrics.ts DESC, id DESC LIMIT 50"""


def a8_recent_chats(spark, sf):
    q = _qm(spark, sf).where(~F.col("guardrail_triggered") & ~F.col("cache_hit")).withColumn(
        "query", F.concat(F.lit("q"), F.col("id").cast("string")))
    ch = M.recent_chats(q, 24, as_of=M.latest_ts(table(spark, sf, "events")))
    return ch.withColumn("ts", F.date_format("ts", TS_FMT))


A8_SQL = with_sql("query_metrics") + f"""SELECT strftime(ts, {DUCK_TS}) AS ts, username, role, 'q' || CAST(id AS VARCHAR) AS query,
  model_used, latency_ms, cache_hit
FROM query_metrics WHERE NOT guardrail_triggered AND NOT cache_hit AND {_win()}
ORDER BY query_metrics.ts DESC, id DESC LIMIT 100"""


def a9_kpi(spark, sf):
    return M.kpi_row(_qm(spark, sf), 24)


A9_SQL = with_sql("query_metrics") + f"""SELECT count(*) AS total_queries, coalesce(round(avg(latency_ms), 1), 0.0) AS avg_latency_ms,
  coalesce(round(sum(cost_usd), 4), 0.0) AS total_cost_usd,
  CAST(coalesce(sum(CASE WHEN guardrail_triggered THEN 1 ELSE 0 END), 0) AS BIGINT) AS guardrail_blocks,
  CAST(coalesce(sum(CASE WHEN cache_hit THEN 1 ELSE 0 END), 0) AS BIGINT) AS cache_hits,
  CASE WHEN count(*) > 0 THEN round(sum(CASE WHEN cache_hit THEN 1 ELSE 0 END) / count(*) * 100.0::DOUBLE, 1) ELSE 0.0 END
    AS cache_rate_pct
FROM query_metrics WHERE {_win()}"""


def _trend_sql(value, how, fill):
    agg = f"avg({value})" if how == "mean" else f"sum({value})"
    out = "round(p.v, 6)" if fill is None else f"round(coalesce(p.v, {fill}), 6)"
    name = "avg_latency_ms" if how == "mean" else "total_cost_usd"
    return with_sql("query_metrics") + f"""
, b AS (SELECT make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS bucket, {value} FROM query_metrics WHERE {_win()}),
p AS (SELECT bucket, {agg} AS v FROM b GROUP BY bucket),
g AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 5 MINUTE)) AS bucket FROM p)
SELECT strftime(g.bucket, {DUCK_TS}) AS bucket, {out} AS {name} FROM g LEFT JOIN p ON g.bucket = p.bucket"""


def a10_latency_trend(spark, sf):
    t = M.latency_trend(_qm(spark, sf), 24)
    return t.select(F.date_format("bucket", TS_FMT).alias("bucket"), _r("avg_latency_ms"))


def a11_cost_trend(spark, sf):
    t = M.cost_trend(_qm(spark, sf), 24)
    return t.select(F.date_format("bucket", TS_FMT).alias("bucket"), _r("total_cost_usd"))


def _counts(key):
    def fn(spark, sf):
        return M.value_counts(_qm(spark, sf), key, 24)
    return fn


def _counts_sql(key):
    return with_sql("query_metrics") + (f"SELECT {key}, count(*) AS queries FROM query_metrics WHERE {key} IS NOT NULL "
                                        f"AND {_win()} GROUP BY {key} ORDER BY queries DESC, {key}")


# -- A1, A4, A9 from stored rollups --------------------------------------------------
def _rollups(spark, sf):
    """Rollups of all hours but the last two, written and read back; the log answers for the rest."""
    path = scratch(spark, "rollups")
    m = _qm(spark, sf)
    RU.refresh(m, path, M.latest_ts(m) - F.make_interval(hours=F.lit(2)))
    return RU.stored(spark, path), m


def _users_close(estimate, exact):
    return (F.abs(estimate - exact) <= F.greatest(F.lit(1.0), 0.02 * exact)).alias("users_within_2_percent")


def a1_rollup_summary(spark, sf):
    rollups, m = _rollups(spark, sf)
    exact = M.metrics_summary(m, 24).select("unique_users").scalar()
    return RU.summary(rollups, m, 24).select("total_queries", _r("avg_latency_ms"), _r("total_cost_usd"), "total_tokens", "cache_hits", "guardrail_blocks",
                                             _users_close(F.col("unique_users"), exact))


A1_ROLLUP_SQL = f"SELECT * EXCLUDE (unique_users), true AS users_within_2_percent FROM ({A1_SQL})"


def a4_rollup_hours(spark, sf):
    rollups, m = _rollups(spark, sf)
    exact = reduce(lambda a, b: a.union(b), [M.in_window(m, h, M.latest_ts(m)).agg(F.lit(h).alias("hours"), F.countDistinct("username").alias("exact"))
                                             for h in L.DASHBOARD_HOURS])
    return RU.hours_selector(rollups, m).join(exact, "hours").select(
        "hours", "total_queries", _r("avg_latency_ms"), _r("total_cost_usd"), "total_tokens", "cache_hits", "guardrail_blocks",
        _users_close(F.col("unique_users"), F.col("exact")))


A4_ROLLUP_SQL = f"SELECT * EXCLUDE (unique_users), true AS users_within_2_percent FROM ({A4_SQL})"


def a9_rollup_kpi(spark, sf):
    return RU.kpi_row(*_rollups(spark, sf), 24)


# -- P5 without gaps: the whole event log as a stream -------------------------------------
def p5_filled_trend(spark, sf):
    """All buckets whose end the watermark (the latest event) has passed, from the stream's sink."""
    path = scratch(spark, "trend")
    events = ST.read_stream(spark, f"{sf}/events.parquet")
    ST.filled_trend_stream(query_metrics(events), path, scratch(spark, "trend-checkpoint"), watermark="0 seconds").awaitTermination()
    return spark.read.parquet(path).select(F.date_format("bucket_start", TS_FMT).alias("bucket"), _r("avg_latency_ms"), _r("total_cost_usd"), "queries")


P5_SQL = with_sql("query_metrics") + f"""
, b AS (SELECT make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS bucket, latency_ms, cost_usd FROM query_metrics),
p AS (SELECT bucket, avg(latency_ms) AS lat, sum(cost_usd) AS cost, count(*) AS n FROM b GROUP BY bucket),
g AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 5 MINUTE)) AS bucket FROM p)
SELECT strftime(g.bucket, {DUCK_TS}) AS bucket, round(p.lat, 6) AS avg_latency_ms, round(CASE WHEN p.n > 0 THEN p.cost ELSE 0.0 END, 6) AS total_cost_usd,
  coalesce(p.n, 0) AS queries
FROM g LEFT JOIN p ON g.bucket = p.bucket WHERE g.bucket + INTERVAL 5 MINUTE <= {AS_OF}"""


QUERIES = {
    "p5_filled_trend": p5_filled_trend,
    "a1_rollup_summary": a1_rollup_summary,
    "a4_rollup_hours": a4_rollup_hours,
    "a9_rollup_kpi": a9_rollup_kpi,
    "a1_metrics_summary": a1_metrics_summary,
    "a2_feedback_summary": a2_feedback_summary,
    "a3_recent_metrics": a3_recent_metrics,
    "a4_hours_selector": a4_hours_selector,
    "a5_feedback_valid": a5_feedback_valid,
    "a5_feedback_rejects": a5_feedback_rejects,
    "a6_feedback_eligible": a6_feedback_eligible,
    "a7_recent_guardrail_events": a7_recent_guardrail_events,
    "a8_recent_chats": a8_recent_chats,
    "a9_kpi": a9_kpi,
    "a10_latency_trend": a10_latency_trend,
    "a11_cost_trend": a11_cost_trend,
    "a12_queries_by_model": _counts("model_used"),
    "a13_queries_by_role": _counts("role"),
    "a14_complexity_distribution": _counts("complexity"),
}
ORACLE = {
    "p5_filled_trend": P5_SQL,
    "a1_rollup_summary": A1_ROLLUP_SQL,
    "a4_rollup_hours": A4_ROLLUP_SQL,
    "a9_rollup_kpi": A9_SQL,
    "a1_metrics_summary": A1_SQL,
    "a2_feedback_summary": A2_SQL,
    "a3_recent_metrics": A3_SQL,
    "a4_hours_selector": A4_SQL,
    "a5_feedback_valid": A5V_SQL,
    "a5_feedback_rejects": A5R_SQL,
    "a6_feedback_eligible": A6_SQL,
    "a7_recent_guardrail_events": A7_SQL,
    "a8_recent_chats": A8_SQL,
    "a9_kpi": A9_SQL,
    "a10_latency_trend": _trend_sql("latency_ms", "mean", None),
    "a11_cost_trend": _trend_sql("cost_usd", "sum", "0.0::DOUBLE"),
    "a12_queries_by_model": _counts_sql("model_used"),
    "a13_queries_by_role": _counts_sql("role"),
    "a14_complexity_distribution": _counts_sql("complexity"),
}
