"""Structured Streaming versions of the guard and the monitor.

* P4 ``guard_stream``: stateless — G6 on each micro-batch, passed and blocked rows
  written by ``foreachBatch`` (one projected batch, two filtered writes).
* P5 ``monitor_stream``: event-time 5-minute windows with a watermark, append mode;
  gap filling is done at read time (append mode emits only non-empty buckets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..operators.guardrails import check_input, guard_split


def guard_stream(messages: DataFrame, passed_path: str, events_path: str, checkpoint: str,
                 text: str = "query", block_on_pii: bool = True, trigger: dict | None = None):
    """Start the guard query; returns the StreamingQuery.

    Each micro-batch overwrites its own folder ``epoch=<n>`` below both paths, so a batch that is
    retried after a failure replaces what it wrote. Readers of the paths see a partition column ``epoch``.
    """
    guarded = check_input(messages, text, block_on_pii=block_on_pii)

    write = guard_batch(passed_path, events_path, text)
    w = guarded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def guard_batch(passed_path: str, events_path: str, text: str = "query"):
    """The function that writes one guarded micro-batch."""
    def write(batch: DataFrame, epoch: int) -> None:
        # the micro-batch feeds two sinks: compute the guard once, then filter
        batch = batch.persist()
        try:
            fwd, events, _ = guard_split(batch, text, ts="ts" if "ts" in batch.columns else None,
                                         materialized=True)
            fwd.drop("guard").write.mode("overwrite").parquet(f"{passed_path}/epoch={epoch}")
            events.write.mode("overwrite").parquet(f"{events_path}/epoch={epoch}")
        finally:
            batch.unpersist()

    return write


def monitor_frames(metrics: DataFrame, watermark: str = "10 minutes", bucket: str = L.TREND_BUCKET):
    """P5 frames: (latency/cost per bucket, model counts per bucket), both append-mode safe."""
    m = metrics.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    trend = m.groupBy(F.window("ts", bucket).alias("w")).agg(
        F.avg("latency_ms").alias("avg_latency_ms"), F.sum("cost_usd").alias("total_cost_usd"),
        F.count(F.lit(1)).alias("queries"))
    by_model = m.where(F.col("model_used").isNotNull()).groupBy(F.window("ts", bucket).alias("w"), "model_used") \
        .agg(F.count(F.lit(1)).alias("queries"))
    flat = [F.col("w.start").alias("bucket_start"), F.col("w.end").alias("bucket_end")]
    return trend.select(*flat, "avg_latency_ms", "total_cost_usd", "queries"), \
        by_model.select(*flat, "model_used", "queries")


def monitor_stream(metrics: DataFrame, trend_path: str, model_path: str, checkpoint: str,
                   watermark: str = "10 minutes", trigger: dict | None = None):
    """P5: start both aggregations as append-mode parquet sinks; returns the two queries."""
    trend, by_model = monitor_frames(metrics, watermark)
    t = trigger or {"availableNow": True}
    q1 = trend.writeStream.outputMode("append").format("parquet").option("path", trend_path) \
        .option("checkpointLocation", checkpoint + "/trend").trigger(**t).start()
    q2 = by_model.writeStream.outputMode("append").format("parquet").option("path", model_path) \
        .option("checkpointLocation", checkpoint + "/models").trigger(**t).start()
    return q1, q2


def fill_trend(trend: DataFrame, bucket_minutes: int = 5) -> DataFrame:
    """P5 read side: gap-fill the appended buckets (A10 NULL latency, A11 0.0 cost).

    Append mode writes only non-empty buckets; the reader joins them to the
    contiguous bucket range, whose size is set by the time span, not the rows.
    """
    span = trend.agg(F.min("bucket_start").alias("lo"), F.max("bucket_start").alias("hi"))
    grid = span.select(F.explode(F.sequence("lo", "hi", F.make_interval(mins=F.lit(bucket_minutes))))
                       .alias("bucket_start"))
    out = grid.join(trend, "bucket_start", "left")
    return out.withColumn("total_cost_usd", F.coalesce(F.col("total_cost_usd"), F.lit(0.0))) \
        .withColumn("queries", F.coalesce(F.col("queries"), F.lit(0)))
