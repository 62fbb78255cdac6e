"""Streams with state against their batch versions: gap-filled trend, cache lookups, sinks without doubles."""

import datetime as dt

from pyspark.sql import functions as F

from bastion.operators import cache as C
from bastion.operators import monitoring as M
from bastion.streaming import stateful as ST

T0 = dt.datetime(2024, 1, 1)
METRICS = "id long, ts timestamp, latency_ms double, cost_usd double"


def minutes(*at):
    return [T0 + dt.timedelta(minutes=m) for m in at]


def arrive(spark, path, batches, schema):
    """Each batch is a file of its own, read by a micro-batch of its own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{k:02d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*")


def run(df, path, **kw):
    df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/out")


def test_filled_trend_equals_batch_trends(spark, tmp_path):
    batches = [[(k, t, float(k), 0.1) for k, t in enumerate(minutes(1, 2, 3))], [(9, minutes(31)[0], None, None), (10, minutes(4)[0], 8.0, 0.5)],
               [(11, minutes(33)[0], 5.0, 0.1)], [(12, minutes(90)[0], 1.0, 1.0), (13, minutes(91)[0], 3.0, 1.0)], [(14, minutes(140)[0], 0.0, 0.0)]]
    stream = arrive(spark, f"{tmp_path}/in", batches, METRICS)
    ST.filled_trend_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", watermark="1 minute").awaitTermination()
    got = sorted((r.bucket_start.replace(tzinfo=None), r.avg_latency_ms, r.total_cost_usd) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    log = spark.createDataFrame([r for b in batches for r in b], METRICS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    lat = {r.bucket: r.avg_latency_ms for r in M.latency_trend(log, 24).collect()}
    cost = {r.bucket: r.total_cost_usd for r in M.cost_trend(log, 24).collect()}
    closed = [b for b in sorted(lat) if b + dt.timedelta(minutes=5) <= T0 + dt.timedelta(minutes=139)]
    assert [(b, lat[b], None if b == minutes(30)[0] and cost[b] is None else cost[b]) for b in closed] == got
    assert len(got) == 27 and sum(r[1] is None for r in got) > 15


def test_series_have_gaps_of_their_own(spark, tmp_path):
    rows = [(1, t, 1.0, 0.0, s) for s, at in (("a", (0, 21)), ("b", (10, 12)), ("c", (60,))) for t in minutes(*at)]
    stream = arrive(spark, f"{tmp_path}/in", [rows, [(2, minutes(100)[0], 1.0, 0.0, "c")]], METRICS + ", model string")
    ST.filled_trend_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", watermark="1 minute", series="model").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("series").agg(F.count("*").alias("n"), F.sum("queries").alias("q"), F.min("bucket_start").alias("lo")).collect()
    got = {r.series: r for r in got}
    assert {s: r.q for s, r in got.items()} == {"a": 2, "b": 2, "c": 1}
    assert got["a"].lo.replace(tzinfo=None) == T0 and got["b"].lo.replace(tzinfo=None) == minutes(10)[0]
    # timers went on emitting empty buckets of a and b up to the watermark (99 minutes)
    assert got["a"].n == 19 and got["b"].n == 17


QUERY, ENTRY = "query_id long, vec array<double>, ts timestamp, role string", "entry_id long, vec array<double>, created_at timestamp, owner_role string"


def test_cache_stream_equals_batch_lookup(spark, tmp_path):
    """Expired, future, equal-time and late entries; several micro-batches; state is dropped after the TTL."""
    vec = lambda k: [1.0, 0.1 * (k % 7), -0.05 * (k % 3)]
    queries = [[(k, vec(k), t, "finance") for k, t in enumerate(minutes(5, 6, 30, 31))], [(k, vec(k), t, "hr") for k, t in enumerate(minutes(62, 70, 95), 10)],
               [(k, vec(k), t, "employees") for k, t in enumerate(minutes(300, 301), 20)]]
    entries = [[(k, vec(k + 1), t, "finance") for k, t in enumerate(minutes(0, 5, 6, 29))], [(k, vec(2 * k), t, "employees") for k, t in enumerate(minutes(40, 61, 66), 10)],
               [(30, vec(3), minutes(299)[0], "c-levelexecutives"), (31, vec(3), minutes(240)[0], "hr")]]
    q = arrive(spark, f"{tmp_path}/q", queries, QUERY)
    e = arrive(spark, f"{tmp_path}/e", entries, ENTRY)
    found = run(ST.cache_candidates(q, e, ttl_s=3600, watermark="2 hours"), tmp_path)
    flat = lambda b, schema: spark.createDataFrame([r for x in b for r in x], schema)
    bq, be = flat(queries, QUERY), flat(entries, ENTRY)
    batch = ST.cache_candidates(bq, be, ttl_s=3600)
    key = lambda df: sorted((r.query_id, r.entry_id, r.sim) for r in df.collect())
    assert key(found) == key(batch)
    best = {(r.query_id, r.entry_id, r.sim, r.hit) for r in ST.best_candidates(found, threshold=0.9).collect()}
    want = {(r.query_id, r.entry_id, r.sim, r.hit) for r in C.lookup(bq, be, ttl_s=3600, threshold=0.9).where("entry_id is not null").collect()}
    assert best == want and len(best) >= 5


def test_entries_behind_the_watermark_are_no_candidates(spark, tmp_path):
    vec = [1.0, 0.0]
    q = arrive(spark, f"{tmp_path}/q", [[(1, vec, minutes(600)[0], "hr")], [(2, vec, minutes(601)[0], "hr")], [(3, vec, minutes(602)[0], "hr")], [(4, vec, minutes(603)[0], "hr")]], QUERY)
    e = arrive(spark, f"{tmp_path}/e", [[(1, vec, minutes(599)[0], "hr")], [(2, vec, minutes(600)[0], "hr")], [(3, vec, minutes(601)[0], "hr")], [(9, vec, minutes(560)[0], "hr")]], ENTRY)
    got = {(r.query_id, r.entry_id) for r in run(ST.cache_candidates(q, e, ttl_s=3600, watermark="5 minutes"), tmp_path).collect()}
    assert (4, 3) in got and (1, 1) in got and not any(i == 9 for _, i in got)  # entry 9 came 40 minutes late


CHAT = "id string, ts timestamp, username string"


def test_a_message_sent_twice_and_a_batch_run_twice_give_one_row(spark, tmp_path):
    batches = [[("a", minutes(0)[0], "u"), ("b", minutes(1)[0], "u"), ("a", minutes(0)[0], "u")], [("b", minutes(1)[0], "again"), ("c", minutes(2)[0], None)]]
    stream = arrive(spark, f"{tmp_path}/in", batches, CHAT)
    for _ in range(2):  # started again after its end: nothing new
        ST.write_once(stream, f"{tmp_path}/chats", f"{tmp_path}/ck", id_col="id", by_date=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/chats")
    assert sorted(r.id for r in got.collect()) == ["a", "b", "c"] and {"epoch", "date"} <= set(got.columns)
    batch = spark.createDataFrame(batches[0][:2], CHAT)
    for _ in range(2):  # the same batch written twice, as after a failure between write and commit
        ST.write_batch_once(batch, f"{tmp_path}/metrics", 7)
    assert spark.read.parquet(f"{tmp_path}/metrics").count() == 2
