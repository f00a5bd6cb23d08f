"""Physical-plan properties that matter at scale."""

import datetime as dt
import tempfile

import pytest

import __spark_entry__ as entry
from conftest import SF001
from meterlens import REPORTS, Tables, driver_tables
from meterlens.sources.tables import PARTITIONING


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: _plan(entry.queries()[name](spark, SF001)) for name in REPORTS}


def test_no_nested_loop_or_cartesian_joins(plans):
    bad = [n for n, p in plans.items() if "NestedLoopJoin" in p or "CartesianProduct" in p]
    assert bad == []


def test_no_python_in_any_plan(plans):
    markers = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")
    assert [n for n, p in plans.items() if any(m in p for m in markers)] == []


def test_idle_reports_use_anti_joins(plans):
    assert "LeftAnti" in plans["idle_roles"]
    assert "LeftAnti" in plans["idle_warehouses"]


def test_longest_queries_counts_instead_of_sorting_the_log(plans):
    # No range exchange and no window over the log: ranks come from counts.
    assert "rangepartitioning(partitions_scanned" not in plans["longest_queries"].lower()
    assert "functions=[count(1)" in plans["longest_queries"] or "count(1)" in plans["longest_queries"]


def test_top_k_is_take_ordered(plans):
    for name in ["most_expensive_queries", "frequent_queries", "top_remote_spillers", "full_scan_queries"]:
        assert "TakeOrderedAndProject" in plans[name], name


def test_time_filters_reach_the_scan(spark):
    df = REPORTS["credits_by_user"](driver_tables(spark, SF001), as_of=dt.datetime(2024, 2, 15))
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts,2024-01-15T00:00)" in plan or \
        "GreaterThan(ts,2024-01-15T00:00)" in plan


def test_partitioned_tables_prune_by_date(spark):
    root = tempfile.mkdtemp(prefix="meterlens-tables-")
    bridge = driver_tables(spark, SF001)
    Tables({n: bridge[n] for n in ["query_history", "warehouse_metering_history"]}).save(root)
    stored = Tables.from_parquet(spark, root, ["query_history", "warehouse_metering_history"])
    df = REPORTS["credits_by_user"](stored, as_of=dt.datetime(2024, 2, 15))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(start_date" in plan and "start_date" in plan
    def split(tables):
        rows = REPORTS["credits_by_user"](tables, as_of=dt.datetime(2024, 2, 15)).collect()
        return sorted((r.user_name, r.warehouse_name, round(r.approximate_credits_used, 6)) for r in rows)

    assert split(stored) == split(bridge)
    spill = _formatted(REPORTS["spill_ratio"](stored))
    assert "Or(GreaterThan(bytes_spilled_to_remote_storage,0),LessThan(bytes_scanned,0))" in spill
    scans = _formatted(REPORTS["full_scan_users"](stored, as_of=dt.datetime(2024, 2, 15)))
    assert "Or(GreaterThan(partitions_scanned,0),LessThan(partitions_total,0))" in scans
    assert sorted(map(tuple, REPORTS["spill_ratio"](stored).collect())) == \
        sorted(map(tuple, REPORTS["spill_ratio"](bridge).collect()))
    buckets = _formatted(REPORTS["execution_time_buckets"](stored, as_of=dt.datetime(2024, 1, 31), warehouse="view"))
    # One pass over the history reads its one value column; the counted rows come from a pruned, filtered scan.
    assert "ReadSchema: struct<total_elapsed_time:bigint>" in buckets and "PushedFilters: [IsNull(query_id)]" in buckets
    assert "EqualTo(warehouse_name,view)" in buckets and "PartitionFilters: [isnotnull(start_date" in buckets


TIME_BOUNDED = {
    "credits_by_user": {}, "credits_by_client": {}, "frequent_queries": {}, "longest_queries": {},
    "most_scanned_queries": {}, "most_expensive_queries": {}, "full_scan_users": {}, "full_scan_queries": {},
    "heavy_scanners": {}, "top_remote_spillers": {}, "cache_usage": {}, "role_segmentation": {}, "queue_pressure": {},
    "query_volume_by_hour": {}, "credits_by_warehouse_recent": {}, "credits_by_hour_of_day": {},
    "cloud_services_ratio": {}, "cost_per_query": {}, "warehouse_utilization": {}, "failed_tasks": {},
    "long_tasks": {}, "idle_roles": {}, "idle_warehouses": {}, "execution_time_buckets": {"warehouse": "view"},
}


def test_catalog_tables_prune_by_date(spark):
    bridge = driver_tables(spark, SF001)
    root = tempfile.mkdtemp(prefix="meterlens-catalog-")
    names = ["query_history", "warehouse_metering_history", "warehouse_load_history", "task_history", "sessions", "roles",
             "warehouses"]
    Tables({n: bridge[n] for n in names}).save(root)
    spark.sql("CREATE DATABASE IF NOT EXISTS telemetry_test")
    try:
        for n in names:
            spark.sql(f"CREATE TABLE telemetry_test.{n} USING parquet LOCATION '{root}/{n}'")
            if n in PARTITIONING:
                spark.sql(f"MSCK REPAIR TABLE telemetry_test.{n}")
        t = Tables.from_catalog(spark, "telemetry_test", names)
        for name, params in TIME_BOUNDED.items():
            plan = _formatted(REPORTS[name](t, as_of=dt.datetime(2024, 2, 1), **params))
            assert "PartitionFilters: [isnotnull(start_date" in plan, name
        got = sorted(map(str, REPORTS["failed_tasks"](t, dt.datetime(2024, 1, 31)).collect()))
        assert got == sorted(map(str, REPORTS["failed_tasks"](bridge, dt.datetime(2024, 1, 31)).collect()))
    finally:
        spark.sql("DROP DATABASE telemetry_test CASCADE")


def test_frequent_queries_drops_other_texts_before_the_shuffle(spark):
    # With broadcast joins off, the bitmap (fixed size, hinted) still stands before any exchange of query texts.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = REPORTS["frequent_queries"](driver_tables(spark, SF001), dt.datetime(2024, 2, 15), min_count=3)
        plan = _plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Read bottom up: the log is scanned, the bitmap tested, and only then are texts exchanged.
    texts = plan.index("hashpartitioning(query_text")
    assert texts < plan.index("BroadcastHashJoin") < plan.index("FileScan")


def test_single_partition_exchanges_only_over_bounded_rows(plans):
    # Final steps of global aggregates and limits: one row per task (longest_queries: the survivors' keys
    # and n + 1 counts; execution_time_buckets: a row per place between edges; usage_forecast: a row per contract
    # day; statement_timeouts: the account's value; warehouse_utilization: the levels of the windows' lengths).
    allowed = {"longest_queries", "usage_forecast", "execution_time_buckets", "statement_timeouts", "warehouse_utilization"}
    assert {n for n, p in plans.items() if "SinglePartition" in p} <= allowed


def test_windows_only_over_aggregated_or_bounded_frames(plans):
    # Each of these windows runs over at most one row per (warehouse, day),
    # (warehouse, role), day of the contract, or place between edges, or the n rows of a top-k.
    allowed = {"warehouse_over_7day_avg", "role_segmentation", "longest_queries", "most_scanned_queries", "usage_forecast",
               "execution_time_buckets"}
    assert {n for n, p in plans.items() if "Window" in p} <= allowed


def test_allocation_reads_the_log_once(spark):
    # Per-user shares and slot totals come from one aggregate of the log;
    # the two branches must stay identical so AQE runs that stage once.
    df = entry.queries()["credits_by_user"](spark, SF001)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final
    assert final.count("FileScan") == 2  # the log once, metering once


# Reports with a join whose sides both come from the log, and the columns an exchange of theirs may carry.
# Wide columns (query_text) reach an exchange only for candidates (frequent_queries) or survivors (top-k).
def test_exchanges_carry_no_wide_columns(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = driver_tables(spark, SF001)
        for name in ["credits_by_user", "credits_by_client", "warehouse_utilization", "idle_roles", "cost_per_query",
                     "role_segmentation", "cache_usage"]:
            text = _formatted(REPORTS[name](tables, as_of=dt.datetime(2024, 2, 15)))
            carried = [line for line in text.splitlines() if line.startswith("Input [")]
            exchanges = text.split("Exchange")[1:]
            assert carried and exchanges, name
            assert not any("query_text" in part.split("Arguments")[0] for part in exchanges), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
