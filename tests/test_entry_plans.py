"""Driver contract and plan-shape checks (SURVEY §5 (d))."""

import __spark_entry__ as E
from conftest import SF_CHECK


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "query_id" in df.columns


def test_registry_consistency():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 55


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_unbroadcast_cartesian(spark):
    for name in ["v5_topk", "c1_cache_lookup", "r2_visible_chunks", "a4_hours_selector", "r4_accessible_counts",
                 "a10_latency_trend", "e9_summary"]:
        p = _plan(E.queries()[name](spark, SF_CHECK))
        assert "CartesianProduct" not in p, name


def test_scan_prunes_columns_and_pushes_filters(spark):
    from bastion.operators.monitoring import metrics_summary
    from bastion.sources.driver_tables import query_metrics, table
    df = metrics_summary(query_metrics(table(spark, SF_CHECK, "events")), 24, as_of="2024-01-05 00:00:00")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-04T00:00" in p
    schema = p[p.index("ReadSchema: "):]
    assert "ts:" in schema and schema.index(">") < 160  # no column beyond those summed


def test_date_partitions_are_pruned(spark, tmp_path):
    import datetime as dt
    from bastion.operators.monitoring import metrics_summary
    from bastion.sources.sinks import append_metrics
    rows = [(d, dt.datetime(2024, 1, d, 12), "u", 1.0, 0.1, 5, False, False) for d in range(1, 11)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, username string, latency_ms double, cost_usd double, "
                                     "tokens_used int, cache_hit boolean, guardrail_triggered boolean")
    append_metrics(df, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    got = metrics_summary(back, 48, as_of="2024-01-10 12:00:00")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "date#" in plan
    assert got.first()["total_queries"] == 3
