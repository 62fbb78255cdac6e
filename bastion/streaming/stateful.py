"""P5, C1/C2, S7 and S8 as streams that keep state.

* ``filled_trend``: the 5-minute trend (A10, A11) without gaps while it streams. Buckets are aggregated first (partial sums on
  all tasks), so the keyed operator that fills gaps sees one row a bucket. It emits the empty buckets before a row, and its
  event-time timer emits an empty bucket as soon as the watermark passes one for which no row came.
* ``cache_candidates``: C1 as a stream-stream interval join. Both sides have watermarks and the join's time bounds let
  Spark drop an entry's state once it is older than the TTL against the queries' watermark (C2).
* ``write_once``: an audit sink (S7, S8) in which a message that is sent twice, or a micro-batch that runs twice, gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import libraries as L
from ..operators.access import can_access
from ..operators.vectors import cosine

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---------------------------------------------------------------------------
# P5: gaps
# ---------------------------------------------------------------------------


class GapFiller(StatefulProcessor):
    """Per key: the start of the last bucket emitted; rows come as (key, start in ms, value, number of rows)."""

    def __init__(self, step_ms: int):
        self.step = step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "start long")

    def _wait(self, last: int) -> None:
        """Wake up when the bucket after ``last`` is over."""
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + 2 * self.step)

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame({"start_ms": pd.array([r[0] for r in rows], "int64"), "avg_latency_ms": pd.array([r[1] for r in rows], "Float64"),
                            "total_cost_usd": pd.array([r[2] for r in rows], "Float64"), "queries": pd.array([r[3] for r in rows], "int64")})
        out.insert(0, "series", key[0])
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        # buckets close in order, but those that close together come in any order
        for at, lat, cost, n in sorted((r for f in rows for r in f[["start_ms", "avg_latency_ms", "total_cost_usd", "queries"]].itertuples(index=False, name=None)),
                                       key=lambda r: r[0]):
            if last is not None:
                out.extend((gap, None, 0.0, 0) for gap in range(last + self.step, at, self.step))
            out.append((at, None if pd.isna(lat) else lat, None if pd.isna(cost) else cost, n))
            last = at
        self.last.update((last,))
        self._wait(last)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, passed = self.last.get()[0], timerValues.getCurrentWatermarkInMs()
        out = []
        while last + 2 * self.step <= passed:
            last += self.step
            out.append((last, None, 0.0, 0))
        self.last.update((last,))
        self._wait(last)
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def filled_trend(metrics: DataFrame, watermark: str = "10 minutes", bucket_minutes: int = 5, series: str | None = None) -> DataFrame:
    """A stream of (series, bucket_start, avg_latency_ms, total_cost_usd, queries), one row a bucket from the first on.

    A bucket is emitted when the watermark has passed its end; empty ones have a NULL latency (A10), 0.0 cost (A11) and 0 queries.
    ``series``: a column whose values have trends of their own (default: one trend named ``all``).
    """
    name = F.coalesce(F.col(series).cast("string"), F.lit("")) if series else F.lit("all")
    m = metrics.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("series", name).withWatermark("ts", watermark)
    per = m.groupBy("series", F.window("ts", f"{bucket_minutes} minutes").alias("w")).agg(
        F.avg("latency_ms").alias("avg_latency_ms"), F.sum("cost_usd").alias("total_cost_usd"), F.count(F.lit(1)).alias("queries"))
    rows = per.select("series", F.unix_millis("w.start").alias("start_ms"), "avg_latency_ms", "total_cost_usd", "queries", F.window_time("w").alias("at"))
    out = rows.groupBy("series").transformWithStateInPandas(
        GapFiller(bucket_minutes * 60_000), "series string, start_ms long, avg_latency_ms double, total_cost_usd double, queries long", "Append", "EventTime")
    return out.select("series", F.timestamp_millis("start_ms").alias("bucket_start"), "avg_latency_ms", "total_cost_usd", "queries")


def filled_trend_stream(metrics: DataFrame, path: str, checkpoint: str, watermark: str = "10 minutes", trigger: dict | None = None, **kw):
    """Start :func:`filled_trend` into Parquet; returns the query. Its state lives in RocksDB, as keyed timers ask for."""
    spark = metrics.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (filled_trend(metrics, watermark, **kw).writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


# ---------------------------------------------------------------------------
# Cache lookups on streams
# ---------------------------------------------------------------------------


def cache_candidates(queries: DataFrame, entries: DataFrame, *, q_id: str = "query_id", q_vec: str = "vec", q_time: str = "ts", role: str = "role",
                     e_id: str = "entry_id", e_vec: str = "vec", e_time: str = "created_at", owner_role: str = "owner_role",
                     ttl_s: int = L.CACHE_TTL_SECONDS, watermark: str = "10 minutes", least: float = 0.0) -> DataFrame:
    """Pairs (q_id, e_id, sim, q_time, e_time, role, owner_role) with 0 < age < TTL and cosine > ``least``, append mode.

    Keyed by TTL buckets as the batch join; the time bounds are repeated as bounds on the two watermarked columns, so
    that state goes when it can no longer match. ``least`` = the cache threshold keeps hits only. Works on batch frames as well.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(int(ttl_s * 1_000_000)))
    q = queries.select(F.col(q_id).alias(q_id), F.col(q_vec).alias("__qv"), F.col(q_time).cast("timestamp").alias("q_time"), F.col(role).alias("role"))
    e = entries.select(F.col(e_id).alias(e_id), F.col(e_vec).alias("__ev"), F.col(e_time).cast("timestamp").alias("e_time"), F.col(owner_role).alias("owner_role"))
    if q.isStreaming:
        q, e = q.withWatermark("q_time", watermark), e.withWatermark("e_time", watermark)
    q = q.withColumn("__qb", F.explode(F.array(bucket(F.col("q_time")), bucket(F.col("q_time")) - 1)))
    e = e.withColumn("__eb", bucket(F.col("e_time")))
    age = F.expr(f"INTERVAL {int(ttl_s)} SECONDS")
    met = q.join(e, (F.col("__qb") == F.col("__eb")) & (F.col("e_time") < F.col("q_time")) & (F.col("e_time") > F.col("q_time") - age))
    return met.withColumn("sim", F.round(cosine("__qv", "__ev"), 6)).where(F.col("sim") > least).select(
        q_id, e_id, "sim", "q_time", "e_time", "role", "owner_role")


def best_candidates(found: DataFrame, q_id: str = "query_id", e_id: str = "entry_id", threshold: float = L.CACHE_THRESHOLD) -> DataFrame:
    """The batch side of a stream of candidates: C1's answer (q_id, e_id, sim, hit) of each query that has any."""
    order = Window.partitionBy(q_id).orderBy(F.col("sim").desc(), F.col("e_time"), F.col(e_id))
    best = found.withColumn("__r", F.row_number().over(order)).where(F.col("__r") == 1)
    return best.select(q_id, e_id, "sim", ((F.col("sim") >= threshold) & can_access("role", "owner_role")).alias("hit"))


# ---------------------------------------------------------------------------
# Sinks that a retry cannot double
# ---------------------------------------------------------------------------


def write_batch_once(df: DataFrame, path: str, batch: int | str, partition_by: tuple[str, ...] = ()) -> None:
    """Write one batch of audit rows under its own name: a batch that runs again replaces what it wrote. Readers see a column ``epoch``."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/epoch={batch}")


def write_once(rows: DataFrame, path: str, checkpoint: str, *, id_col: str, ts: str = "ts", watermark: str = "1 hour", by_date: bool = False,
               trigger: dict | None = None):
    """Start an audit sink: one row for each ``id_col``, however often it is sent within ``watermark`` of its first arrival."""
    once = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([id_col])
    once = once.withColumn("date", F.to_date(ts)) if by_date else once

    def write(batch: DataFrame, epoch: int) -> None:
        write_batch_once(batch, path, epoch, ("date",) if by_date else ())

    return (once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stored table (a Parquet file or folder) as a stream."""
    # a pattern that matches the path alone: the stream source takes a single file only so
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
