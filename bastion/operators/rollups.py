"""A1, A4 and A9 from stored hourly rollups.

A rollup row holds what an hour of query_metrics adds to any window: counts, exact sums (latency in integer nanounits,
cost in integer micro-dollars, as T4 makes it) and a mergeable sketch of the users. A window is answered from the rollups
of the hours that lie wholly inside it and the log rows of the hours that do not: the one its start cuts and those not yet
rolled up. Sums and counts equal those over the log exactly; distinct users are estimated by the union of the
sketches (HyperLogLog with 2**LG_K registers, relative standard error about 0.65 % at 14; exact to rounding for a few
thousand users). A dashboard over years of log rows so reads one row an hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import libraries as L
from .monitoring import _as_of, latest_ts

LG_K = 14
#: Parts of a unit that latency and cost are counted in.
LATENCY_UNIT, COST_UNIT = 1_000_000_000, 1_000_000
SUMS = ("n", "lat_sum", "lat_n", "cost_sum", "cost_n", "tok_sum", "tok_n", "hits", "blocks")


def _partials(rows: DataFrame, *keys: Column) -> DataFrame:
    exact = lambda c, unit: F.sum(F.round(F.col(c).cast("decimal(28,12)") * F.lit(unit)).cast("decimal(28,0)")).cast("decimal(38,0)")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("decimal(38,0)").alias("n"),
        exact("latency_ms", LATENCY_UNIT).alias("lat_sum"), F.count("latency_ms").cast("decimal(38,0)").alias("lat_n"),
        exact("cost_usd", COST_UNIT).alias("cost_sum"), F.count("cost_usd").cast("decimal(38,0)").alias("cost_n"),
        F.sum("tokens_used").cast("decimal(38,0)").alias("tok_sum"), F.count("tokens_used").cast("decimal(38,0)").alias("tok_n"),
        F.count_if(F.col("cache_hit")).cast("decimal(38,0)").alias("hits"), F.count_if(F.col("guardrail_triggered")).cast("decimal(38,0)").alias("blocks"),
        F.hll_sketch_agg("username", F.lit(LG_K)).alias("users"))


def _hour(ts: str) -> Column:
    return F.date_trunc("HOUR", F.col(ts)).cast("timestamp_ntz")


def hourly(metrics: DataFrame, ts: str = "ts") -> DataFrame:
    """One row an hour: ``hour``, the sums and the sketch ``users`` (partial aggregates before the shuffle)."""
    return _partials(metrics, _hour(ts).alias("hour"))


def refresh(metrics: DataFrame, path: str, closed_before, since=None, ts: str = "ts") -> None:
    """Write the rollups of all hours from ``since`` (None: the first) up to ``closed_before``, replacing their days.

    Days are partitions and only those from ``since``'s day on are overwritten, so a refresh that is run again or that
    reaches back for late rows leaves one row an hour.
    """
    rows = metrics.where(F.col(ts) < F.date_trunc("HOUR", _as_of(closed_before)))
    if since is not None:
        rows = rows.where(F.col(ts) >= F.date_trunc("DAY", _as_of(since)))
    out = hourly(rows, ts).withColumn("date", F.to_date("hour"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    sums = ", ".join(f"{c} decimal(38,0)" for c in SUMS)
    return spark.read.schema(f"hour timestamp_ntz, {sums}, users binary, date date").parquet(path)


def window_rows(rollups: DataFrame, metrics: DataFrame, hours: int, as_of, ts: str = "ts") -> DataFrame:
    """Rollup rows that together make up ``ts >= as_of - hours``: whole stored hours, and log rows for the rest."""
    start = _as_of(as_of) - F.make_interval(hours=F.lit(hours))
    whole = F.date_trunc("HOUR", start).cast("timestamp_ntz")
    whole = F.when(whole < start, whole + F.make_interval(hours=F.lit(1))).otherwise(whole)  # first hour wholly inside
    upto = rollups.agg(F.max("hour")).scalar() + F.make_interval(hours=F.lit(1))  # stored hours end here
    inside = rollups.where((F.col("hour") >= whole) & (F.col("date") >= F.to_date(whole)))
    rest = metrics.where((F.col(ts) >= start) & ((F.col(ts) < whole) | F.coalesce(F.col(ts) >= upto, F.lit(True))))
    return inside.select(*SUMS, "users").union(_partials(rest).where("n > 0").select(*SUMS, "users"))


def _summary(rows: DataFrame, *keys: str) -> DataFrame:
    both = [F.sum(c).alias(c) for c in SUMS]
    a = rows.groupBy(*keys).agg(*both, F.hll_union_agg("users").alias("users"))
    ratio = lambda s, n, unit: F.when(F.col(n) > 0, F.col(s).cast("double") / F.lit(float(unit)) / F.col(n).cast("double"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return a.select(
        *keys, count("n").alias("total_queries"), ratio("lat_sum", "lat_n", LATENCY_UNIT).alias("avg_latency_ms"),
        F.when(F.col("cost_n") > 0, F.col("cost_sum").cast("double") / F.lit(float(COST_UNIT))).alias("total_cost_usd"),
        F.when(F.col("tok_n") > 0, F.col("tok_sum")).cast("long").alias("total_tokens"),
        count("hits").alias("cache_hits"), count("blocks").alias("guardrail_blocks"),
        F.coalesce(F.hll_sketch_estimate("users"), F.lit(0)).alias("unique_users"))


def summary(rollups: DataFrame, metrics: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """A1 from rollups: one row; an empty window gives count 0 and NULL sums."""
    return _summary(window_rows(rollups, metrics, hours, latest_ts(metrics) if as_of is None else as_of))


def hours_selector(rollups: DataFrame, metrics: DataFrame, hours_list=tuple(L.DASHBOARD_HOURS), as_of=None) -> DataFrame:
    """A4 from rollups: A1 of each window; windows without rows are kept."""
    as_of = latest_ts(metrics) if as_of is None else as_of
    parts = None
    for h in sorted(hours_list):
        one = window_rows(rollups, metrics, h, as_of).withColumn("hours", F.lit(h))
        parts = one if parts is None else parts.union(one)
    found = _summary(parts, "hours")
    every = metrics.sparkSession.createDataFrame([(h,) for h in sorted(hours_list)], "hours int")
    return every.join(F.broadcast(found), "hours", "left").fillna(0, ["total_queries", "cache_hits", "guardrail_blocks", "unique_users"])  # a row a window


def kpi_row(rollups: DataFrame, metrics: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """A9 from rollups: zeros when empty."""
    a = summary(rollups, metrics, hours, as_of)
    return a.select(
        "total_queries", F.coalesce(F.round("avg_latency_ms", 1), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.round("total_cost_usd", 4), F.lit(0.0)).alias("total_cost_usd"), "guardrail_blocks", "cache_hits",
        F.when(F.col("total_queries") > 0, F.round(F.col("cache_hits") / F.col("total_queries") * 100.0, 1)).otherwise(F.lit(0.0)).alias("cache_rate_pct"))
