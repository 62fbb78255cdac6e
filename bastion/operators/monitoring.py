"""Monitoring aggregates over the query_metrics fact table.

Every operator takes an explicit ``as_of`` (a literal timestamp or a Column, e.g. a
scalar subquery) instead of reading the clock, and pins the time window with a
filter on ``ts`` that reaches the parquet scan as a pushed predicate. Aggregates
are partial-then-final (map-side combine); there is no global un-partitioned
window: trends gap-fill by joining a generated bucket range, and the hours
selector joins a six-row window dimension.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..functions.text import epoch_us, ntz_from_epoch_us

BUCKET_US = 5 * 60 * 1_000_000


def _as_of(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (dt.datetime, str)):
        return F.lit(as_of).cast("timestamp_ntz")
    raise TypeError("as_of must be a Column, datetime or string")


def latest_ts(df: DataFrame, ts: str = "ts") -> Column:
    """``(SELECT max(ts) FROM df)`` as a scalar-subquery Column (lazy, one tiny job)."""
    return df.select(F.max(ts)).scalar()


def in_window(df: DataFrame, hours: int, as_of, ts: str = "ts", date: str = "date") -> DataFrame:
    """``ts >= as_of - hours`` (the service's window has no upper bound).

    A table written by the metrics sink has a partition column ``date``; it is filtered too, so
    that older partitions are not read. Pass ``as_of`` as a literal where it is known: the default
    of the callers, the latest timestamp, reads that column of the whole table first.
    """
    start = _as_of(as_of) - F.make_interval(hours=F.lit(hours))
    if dict(df.dtypes).get(date) == "date":
        df = df.where(F.col(date) >= F.to_date(start))
    return df.where(F.col(ts) >= start)


def _summary_aggs(user: str = "username"):
    return [
        F.count(F.lit(1)).alias("total_queries"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum("cost_usd").alias("total_cost_usd"),
        F.sum("tokens_used").cast("long").alias("total_tokens"),
        F.sum(F.when(F.col("cache_hit"), 1).otherwise(0)).cast("long").alias("cache_hits"),
        F.sum(F.when(F.col("guardrail_triggered"), 1).otherwise(0)).cast("long").alias("guardrail_blocks"),
        F.countDistinct(user).alias("unique_users"),
    ]


def metrics_summary(metrics: DataFrame, hours: int = 24, as_of=None, approx_users: bool = False) -> DataFrame:
    """A1: one row; empty window -> count 0 and NULL sums/avg."""
    as_of = latest_ts(metrics) if as_of is None else as_of
    aggs = _summary_aggs()
    if approx_users:
        aggs[-1] = F.approx_count_distinct("username").alias("unique_users")
    return in_window(metrics, hours, as_of).agg(*aggs)


def recent_metrics(metrics: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """A3: window filter, newest first, all columns (a range-partitioned global sort)."""
    as_of = latest_ts(metrics) if as_of is None else as_of
    return in_window(metrics, hours, as_of).orderBy(F.col("ts").desc(), F.col("id").desc())


def hours_selector(metrics: DataFrame, hours_list=tuple(L.DASHBOARD_HOURS), as_of=None) -> DataFrame:
    """A4: A1 for every dashboard window in one pass over the data.

    Each row is tagged with the smallest window containing it and aggregated once
    per tag; users are reduced to their smallest tag. A window's figures are then
    the sums over tags <= window, a join of two tables of at most six rows.
    """
    spark = metrics.sparkSession
    as_of = _as_of(latest_ts(metrics) if as_of is None else as_of)
    hs = sorted(hours_list)
    tag = None
    for h in hs:
        cond = F.col("ts") >= as_of - F.make_interval(hours=F.lit(h))
        tag = F.when(cond, F.lit(h)) if tag is None else tag.when(cond, F.lit(h))
    tagged = in_window(metrics, hs[-1], as_of).withColumn("w", tag)
    per_w = tagged.groupBy("w").agg(
        F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("lat_sum"),
        F.count("latency_ms").alias("lat_n"), F.sum("cost_usd").alias("cost"),
        F.sum("tokens_used").alias("tok"),
        F.sum(F.when(F.col("cache_hit"), 1).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("guardrail_triggered"), 1).otherwise(0)).alias("blocks"))
    users = tagged.where(F.col("username").isNotNull()).groupBy("username").agg(F.min("w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("u"))
    per_w = per_w.join(users, "w", "full")
    dim = spark.createDataFrame([(h,) for h in hs], "hours int")
    j = dim.join(F.broadcast(per_w), F.col("w") <= F.col("hours"), "left")
    return j.groupBy("hours").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_queries"),
        (F.sum("lat_sum") / F.sum("lat_n")).alias("avg_latency_ms"),
        F.sum("cost").alias("total_cost_usd"),
        F.sum("tok").cast("long").alias("total_tokens"),
        F.sum("hits").cast("long").alias("cache_hits"),
        F.sum("blocks").cast("long").alias("guardrail_blocks"),
        F.coalesce(F.sum("u"), F.lit(0)).cast("long").alias("unique_users"),
    )


def recent_events(events: DataFrame, hours: int = 24, as_of=None, limit: int = L.RECENT_EVENTS_LIMIT,
                  cols=("ts", "username", "role", "event_type", "reason")) -> DataFrame:
    """Newest ``limit`` guardrail events (TakeOrderedAndProject: per-partition top-k)."""
    as_of = latest_ts(events) if as_of is None else as_of
    return in_window(events, hours, as_of).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit) \
        .select(*cols)


def recent_chats(chats: DataFrame, hours: int = 24, as_of=None, limit: int = L.RECENT_CHATS_LIMIT,
                 cols=("ts", "username", "role", "query", "model_used", "latency_ms", "cache_hit")) -> DataFrame:
    """Newest ``limit`` chats."""
    return recent_events(chats, hours, as_of, limit, cols)


def kpi_row(metrics: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """Count, avg latency (1 dp), cost (4 dp), blocks, hits, cache rate % (1 dp); zeros when empty."""
    as_of = latest_ts(metrics) if as_of is None else as_of
    a = in_window(metrics, hours, as_of).agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("lat"), F.sum("cost_usd").alias("cost"),
        F.sum(F.when(F.col("guardrail_triggered"), 1).otherwise(0)).alias("blocks"),
        F.sum(F.when(F.col("cache_hit"), 1).otherwise(0)).alias("hits"))
    return a.select(
        F.col("n").alias("total_queries"),
        F.coalesce(F.round("lat", 1), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.round("cost", 4), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.col("blocks"), F.lit(0)).cast("long").alias("guardrail_blocks"),
        F.coalesce(F.col("hits"), F.lit(0)).cast("long").alias("cache_hits"),
        F.when(F.col("n") > 0, F.round(F.col("hits") / F.col("n") * 100.0, 1)).otherwise(F.lit(0.0))
        .alias("cache_rate_pct"),
    )


def bucket_start(df: DataFrame, ts: str = "ts", bucket_us: int = BUCKET_US) -> Column:
    """Epoch-aligned tumbling bucket start (what a 5-minute resample uses), as TIMESTAMP_NTZ."""
    return ntz_from_epoch_us(F.floor(epoch_us(df, ts) / bucket_us) * bucket_us)


def _trend(metrics: DataFrame, value: str, how: str, fill, hours: int, as_of, bucket_us: int) -> DataFrame:
    as_of = latest_ts(metrics) if as_of is None else as_of
    base = in_window(metrics, hours, as_of)
    base = base.withColumn("bucket", bucket_start(base, "ts", bucket_us))
    agg = F.avg(value) if how == "mean" else F.sum(value)
    per = base.groupBy("bucket").agg(agg.alias("v"))
    # Contiguous buckets from the first to the last non-empty one; the range is
    # bounded by the time span, not by the row count.
    span = per.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = span.select(F.explode(F.sequence("lo", "hi", F.make_interval(mins=F.lit(bucket_us // 60_000_000))))
                       .alias("bucket"))
    out = grid.join(per, "bucket", "left")
    if fill is not None:
        out = out.withColumn("v", F.coalesce(F.col("v"), F.lit(fill)))
    return out


def latency_trend(metrics: DataFrame, hours: int = 24, as_of=None, bucket_us: int = BUCKET_US) -> DataFrame:
    """A10: 5-minute mean latency, empty buckets NULL."""
    return _trend(metrics, "latency_ms", "mean", None, hours, as_of, bucket_us).withColumnRenamed(
        "v", "avg_latency_ms")


def cost_trend(metrics: DataFrame, hours: int = 24, as_of=None, bucket_us: int = BUCKET_US) -> DataFrame:
    """5-minute summed cost, empty buckets 0.0."""
    return _trend(metrics, "cost_usd", "sum", 0.0, hours, as_of, bucket_us).withColumnRenamed("v", "total_cost_usd")


def value_counts(metrics: DataFrame, key: str, hours: int = 24, as_of=None) -> DataFrame:
    """Count per non-NULL key, descending (ties by key)."""
    as_of = latest_ts(metrics) if as_of is None else as_of
    return (in_window(metrics, hours, as_of).where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("queries")).orderBy(F.col("queries").desc(), F.col(key)))
