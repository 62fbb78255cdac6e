"""A1/A4/A9 from rollups, S5 as a bucketed merge, S6 with C5 as a versioned publish."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from bastion.operators import monitoring as M
from bastion.operators import rollups as RU
from bastion.operators.cache import invalidate
from bastion.sources import versions
from bastion.sources.sinks import merge_latest, publish_index, upsert_latest

T0 = dt.datetime(2024, 3, 1)
METRICS = ("id long, ts timestamp_ntz, username string, model_used string, latency_ms double, tokens_used int, cost_usd double, cache_hit boolean, "
           "guardrail_triggered boolean")


def log(spark, n=3000, users=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        at = T0 + dt.timedelta(seconds=rng.randrange(9 * 24 * 3600), microseconds=rng.randrange(10 ** 6))
        rows.append((k, at, None if rng.random() < 0.05 else f"u{rng.randrange(users)}", "m", None if rng.random() < 0.1 else round(rng.random() * 900, 4),
                     None if rng.random() < 0.1 else rng.randrange(500), rng.randrange(10 ** 6) / 10 ** 6, rng.random() < 0.3, rng.random() < 0.1))
    rows.append((n, T0, "edge", "m", 1.0, 1, 0.000001, None, None))
    return spark.createDataFrame(rows, METRICS)


def same(got, want):
    for g, w in zip(got, want):
        for k in w.asDict():
            if isinstance(w[k], float):
                assert g[k] == pytest.approx(w[k], abs=1e-9), k
            else:
                assert g[k] == w[k], k


@pytest.mark.parametrize("as_of", ["2024-03-09 12:34:56.789", "2024-03-05 00:00:00", "2024-03-04 23:59:59.999999", "2024-02-01 00:00:00"])
def test_windows_equal_the_log(spark, tmp_path, as_of):
    m = log(spark)
    RU.refresh(m, str(tmp_path / "r"), "2024-03-08 10:20:00")
    rollups = RU.stored(spark, str(tmp_path / "r"))
    for hours in (1, 24, 167):
        same(RU.summary(rollups, m, hours, as_of).collect(), M.metrics_summary(m, hours, as_of).collect())
        same(RU.kpi_row(rollups, m, hours, as_of).collect(), M.kpi_row(m, hours, as_of).collect())
    order = lambda df: df.orderBy("hours").collect()
    same(order(RU.hours_selector(rollups, m, as_of=as_of)), order(M.hours_selector(m, as_of=as_of)))


def test_refresh_again_and_late_rows(spark, tmp_path):
    m, path = log(spark), str(tmp_path / "r")
    RU.refresh(m.where("id % 7 > 0"), path, "2024-03-09 00:00:00")
    old = sorted(glob.glob(f"{path}/date=2024-03-02/*"))
    RU.refresh(m, path, "2024-03-10 00:00:00", since="2024-03-05 13:00:00")  # late rows of the last days
    RU.refresh(m, path, "2024-03-10 00:00:00", since="2024-03-05 13:00:00")
    rollups = RU.stored(spark, path)
    assert rollups.count() == rollups.select("hour").distinct().count()
    assert sorted(glob.glob(f"{path}/date=2024-03-02/*")) == old
    whole = RU.hourly(m).where("hour >= timestamp_ntz'2024-03-05 00:00:00'").select("hour", "n", "lat_sum", "cost_sum")
    assert rollups.where("date >= date'2024-03-05'").select("hour", "n", "lat_sum", "cost_sum").exceptAll(whole).count() == 0


def test_distinct_users_stay_within_the_sketch_error(spark, tmp_path):
    m = spark.range(200_000).select(
        F.col("id"), (F.lit(T0).cast("timestamp_ntz") + F.make_interval(secs=F.col("id") % 86400)).alias("ts"), F.concat(F.lit("u"), F.col("id") % 60_000).alias("username"),
        F.lit("m").alias("model_used"), F.lit(1.0).alias("latency_ms"), F.lit(1).alias("tokens_used"), F.lit(0.1).alias("cost_usd"), F.lit(True).alias("cache_hit"),
        F.lit(False).alias("guardrail_triggered"))
    RU.refresh(m, str(tmp_path / "r"), "2024-03-02 00:00:00")
    got = RU.summary(RU.stored(spark, str(tmp_path / "r")), m.limit(0), 48, "2024-03-02 00:00:00").first()
    assert got["total_queries"] == 200_000 and abs(got["unique_users"] - 60_000) <= 3 * 0.0065 * 60_000


def test_empty_log_and_no_rollups(spark, tmp_path):
    m = log(spark).limit(0)
    RU.refresh(m, str(tmp_path / "r"), "2024-03-02 00:00:00")
    rollups = RU.stored(spark, str(tmp_path / "r"))
    assert RU.summary(rollups, m, 24, "2024-03-02 00:00:00").first()["total_queries"] == 0
    some = log(spark, 50)
    same(RU.summary(rollups, some, 400, "2024-03-10 00:00:00").collect(), M.metrics_summary(some, 400, "2024-03-10 00:00:00").collect())


# -- S5 -----------------------------------------------------------------------
META = "chunk_id string, file_name string, indexed_at timestamp_ntz"


def meta(spark, ids, name, hour):
    return spark.createDataFrame([(f"c{i}", name, T0 + dt.timedelta(hours=hour)) for i in ids], META)


def test_merge_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    first, again = meta(spark, range(500), "a", 0), meta(spark, [3, 3, 700, 701], "b", 1)
    assert len(merge_latest(spark, first, path, buckets=16)) == 16
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    touched = merge_latest(spark, again, path, buckets=16)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    kept = {f: t for f, t in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert len(touched) <= 3 and kept and kept.items() <= after.items() and set(before) - set(kept) and not (set(before) - set(kept)) & set(after)
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).drop("bucket").collect())
    want = sorted(tuple(r) for r in upsert_latest(first, again).collect())
    assert read() == want
    merge_latest(spark, again, path, buckets=16)  # run again: nothing changes
    merge_latest(spark, meta(spark, [5], "older", -1), path, buckets=16)
    assert read() == want
    assert merge_latest(spark, again.limit(0), path, buckets=16) == [] and read() == want


# -- S6, C5 ---------------------------------------------------------------------
def index(spark, tag, n):
    chunks = spark.createDataFrame([(f"{tag}{i}", "hr" if i % 2 else "finance", tag) for i in range(n)], "chunk_id string, department string, text string")
    return chunks, chunks.select("chunk_id", F.col("department").alias("role"))


def test_publish_switches_both_tables_at_once(spark, tmp_path):
    root = str(tmp_path / "p")
    assert versions.current_version(spark, root) is None
    one = publish_index(*index(spark, "a", 10), root)
    pinned = versions.current_version(spark, root)
    chunks, rows = index(spark, "b", 6)
    broken = rows.withColumn("role", F.raise_error(F.lit("disk full")).cast("string"))
    with pytest.raises(Exception, match="disk full"):
        publish_index(chunks, broken, root)  # the index is written, its metadata fails
    assert versions.current_version(spark, root) == pinned == one == 1
    ids = lambda t, v=None: {r.chunk_id for r in versions.read(spark, root, t, v).collect()}
    assert ids("chunks") == ids("doc_chunks") == {f"a{i}" for i in range(10)}
    two = publish_index(chunks, rows, root)
    assert two > one and ids("chunks") == ids("doc_chunks") == {f"b{i}" for i in range(6)}
    assert ids("chunks", pinned) == {f"a{i}" for i in range(10)}  # a reader that pinned the first version
    entries = spark.createDataFrame([(1, one), (2, two)], "entry_id int, index_version int")
    assert [r.entry_id for r in invalidate(entries, versions.current_version(spark, root)).collect()] == [2]
    assert versions.prune(spark, root, keep=1) == [one]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, "chunks", one)


def test_departments_are_partitions_of_a_version(spark, tmp_path):
    publish_index(*index(spark, "a", 10), str(tmp_path))
    plan = versions.read(spark, str(tmp_path), "chunks").where("department = 'hr'")
    assert plan.count() == 5 and "PartitionFilters: [isnotnull(department" in plan._jdf.queryExecution().executedPlan().toString()


def test_ingest_publishes_its_version(spark, tmp_path):
    from bastion.plans.ingest import ingest
    corpus, root = tmp_path / "corpus" / "HR", str(tmp_path / "p")
    corpus.mkdir(parents=True)
    (corpus / "policy.txt").write_text("Leave policy: 20 days.")
    for k in (1, 2):
        ingest(spark, str(tmp_path / "corpus"), publish_root=root)
        got = versions.read(spark, root, "chunks")
        assert versions.current_version(spark, root) == k and {r.index_version for r in got.collect()} == {k}
