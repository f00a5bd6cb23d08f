"""Report semantics on small hand-made telemetry (FIXTURES.md §4)."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest

from meterlens import REPORTS, SCHEMAS, Tables
from meterlens.sources.tables import conform

D = Decimal
AS_OF = dt.datetime(2024, 2, 15)


def _table(spark, name, rows):
    schema = SCHEMAS[name]
    full = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return conform(spark.createDataFrame(full, schema), name)


def _tables(spark, **tables):
    return Tables({name: _table(spark, name, rows) for name, rows in tables.items()})


def _qh(i, **kw):
    base = dict(query_id=str(i), query_text=f"q{i}", query_type="SELECT", user_name="u", role_name="r",
                warehouse_name="w", warehouse_size="Small", session_id=1, start_time=dt.datetime(2024, 2, 1, 10),
                end_time=dt.datetime(2024, 2, 1, 10, 1), execution_time=1000, total_elapsed_time=1000,
                partitions_scanned=1, partitions_total=10, bytes_scanned=100, bytes_spilled_to_remote_storage=0,
                percentage_scanned_from_cache=0.5)
    base.update(kw)
    return base


def _wmh(wh, start, credits):
    return dict(warehouse_id=1, warehouse_name=wh, start_time=start, end_time=start + dt.timedelta(hours=1),
                credits_used=D(credits), credits_used_compute=D(credits), credits_used_cloud_services=D("0"))


def test_warehouse_over_7day_avg_is_a_row_frame(spark):
    # Days 1..10 with a gap on day 5; the mean covers the 7 preceding *rows*.
    credits = {1: 100, 2: 100, 3: 100, 4: 100, 6: 100, 7: 100, 8: 100, 9: 100, 10: 900}
    rows = [_wmh("w", dt.datetime(2024, 1, d, 3), str(c)) for d, c in credits.items()]
    rows += [_wmh("small", dt.datetime(2024, 1, 10, 3), "150")]  # one day only: mean == value, 0 %
    out = REPORTS["warehouse_over_7day_avg"](_tables(spark, warehouse_metering_history=rows)).collect()
    assert len(out) == 1
    r = out[0]
    want_avg = (100 * 7 + 900) / 8
    assert r.start_date == dt.date(2024, 1, 10) and r.warehouse_name == "w"
    assert r.credits_used_7_day_avg == pytest.approx(want_avg)
    assert r.pct_over_to_7_day_average == pytest.approx(100 * (900 / want_avg - 1), abs=1e-6)


def test_role_segmentation_drops_single_role_warehouses(spark):
    qh = [_qh(1, role_name="a"), _qh(2, role_name="b"), _qh(3, warehouse_name="solo", role_name="a"),
          _qh(4, role_name="a", execution_time=3000)]
    out = REPORTS["role_segmentation"](_tables(spark, query_history=qh), AS_OF).collect()
    assert [(r.warehouse_name, r.role_name, r.average_execution_time, r.count_of_queries, r.roles_per_warehouse)
            for r in out] == [("w", "a", 2000.0, 2, 2), ("w", "b", 1000.0, 1, 2)]


def test_spill_ratio_zero_scanned_is_null(spark):
    qh = [_qh(1, bytes_scanned=0, bytes_spilled_to_remote_storage=10),
          _qh(2, bytes_scanned=10, bytes_spilled_to_remote_storage=100),
          _qh(3, bytes_scanned=10, bytes_spilled_to_remote_storage=50)]
    out = {r.query_id: r.spilling_read_ratio for r in REPORTS["spill_ratio"](_tables(spark, query_history=qh)).collect()}
    assert out == {"1": None, "2": 10.0}


def test_most_expensive_size_lookup(spark):
    qh = [_qh(1, warehouse_size="xLarge", execution_time=3_600_000), _qh(2, warehouse_size="unknown"),
          _qh(3, warehouse_size=None)]
    out = REPORTS["most_expensive_queries"](_tables(spark, query_history=qh), AS_OF).collect()
    assert [(r.query_id, r.warehouse_size, r.nodes, r.relative_performance_cost) for r in out] == [
        ("1", "XLARGE", 16, 16.0)]


def test_idle_roles_and_users(spark):
    roles = [dict(name="r"), dict(name="idle"), dict(name="gone", deleted_on=dt.datetime(2024, 1, 1)), dict(name=None)]
    qh = [_qh(1, role_name="r"), _qh(2, role_name=None), _qh(3, role_name="idle", start_time=dt.datetime(2023, 1, 1))]
    out = sorted((r.name or "") for r in REPORTS["idle_roles"](_tables(spark, roles=roles, query_history=qh), AS_OF)
                 .collect())
    assert out == ["", "idle"]
    users = [dict(name="old", last_success_login=dt.datetime(2023, 1, 1)), dict(name="never"),
             dict(name="never_gone", deleted_on=dt.datetime(2023, 6, 1)),
             dict(name="gone", last_success_login=dt.datetime(2023, 1, 1), deleted_on=dt.datetime(2023, 6, 1)),
             dict(name="recent", last_success_login=dt.datetime(2024, 2, 10))]
    t = _tables(spark, users=users)
    assert [r.name for r in REPORTS["idle_users"](t, AS_OF).collect()] == ["old"]
    assert sorted(r.name for r in REPORTS["users_never_logged_in"](t).collect()) == ["never", "never_gone"]


def test_statement_timeouts_effective_value(spark):
    p = [dict(name="STATEMENT_TIMEOUT_IN_SECONDS", level="ACCOUNT", object="acct", value=3600),
         dict(name="STATEMENT_TIMEOUT_IN_SECONDS", level="WAREHOUSE", object="wh", value=600),
         dict(name="STATEMENT_TIMEOUT_IN_SECONDS", level="USER", object="bob", value=0),
         dict(name="STATEMENT_TIMEOUT_IN_SECONDS", level="USER", object="amy", value=7200),
         dict(name="STATEMENT_TIMEOUT_IN_SECONDS", level="WAREHOUSE", object="both", value=900),
         dict(name="STATEMENT_TIMEOUT_IN_SECONDS", level="USER", object="both", value=300),
         dict(name="TIMEZONE", level="ACCOUNT", object="acct", value=0)]
    out = REPORTS["statement_timeouts"](_tables(spark, parameters=p))
    assert out.columns == ["object", "effective_seconds"]
    assert {r.object: r.effective_seconds for r in out.collect()} == {
        "acct": 3600, "wh": 600, "bob": 3600, "amy": 7200, "both": 300}


def test_usage_forecast_skips_days_without_usage(spark):
    start = dt.datetime(2000, 1, 1)
    days = [0, 1, 3, 7, 30, 59]  # Feb 29 (day 59) included: leap year
    wmh = [_wmh("w", start + dt.timedelta(days=d, hours=5), str(10 + 2 * d)) for d in days]
    empty = {k: [] for k in ["pipe_usage_history", "automatic_clustering_history", "materialized_view_refresh_history",
                             "search_optimization_history", "replication_usage_history", "storage_usage"]}
    t = _tables(spark, warehouse_metering_history=wmh, **empty)
    out = REPORTS["usage_forecast"](t, term_start="2000-01-01").collect()
    assert len(out) == 366 and out[-1].consumption_date == dt.date(2000, 12, 31)
    x = np.array(days, dtype=float)
    y = np.array([4 * (10 + 2 * d) for d in days], dtype=float)
    slope, intercept = np.polyfit(x, y, 1)
    for r in out[:70]:
        k = (r.consumption_date - dt.date(2000, 1, 1)).days
        assert r.forecasted_dollars_used == pytest.approx(k * slope + intercept, abs=1e-6)
        assert (r.actual_dollars_used is None) == (k not in days)
    assert out[0].contracted_dollars_used == Decimal("273.97260273973")


def test_billing_ledger_totals(spark):
    wmh = [_wmh("w", dt.datetime(2000, 1, 1, h), "1.25") for h in range(3)]
    su = [dict(usage_date=dt.date(2000, 2, 1), storage_bytes=1024 ** 4 * 29, stage_bytes=0, failsafe_bytes=0)]
    empty = {k: [] for k in ["pipe_usage_history", "automatic_clustering_history", "materialized_view_refresh_history",
                             "search_optimization_history", "replication_usage_history"]}
    t = _tables(spark, warehouse_metering_history=wmh, storage_usage=su, **empty)
    out = REPORTS["billing_ledger"](t, term_start="2000-01-01").collect()
    by = {}
    for r in out:
        by.setdefault(r.measure_type, []).append(r)
    assert len(by["PROJECTED COMPUTE"]) == 367  # start .. start + 12 months inclusive
    assert [r.dollars_used for r in by["CONTRACT VALUES"]] == [Decimal("100000")]
    actual = sorted((r.warehouse_group_name, r.dollars_used) for r in by["ACTUAL COMPUTE"])
    assert actual == [("Storage", Decimal("23"))] + [("WH Compute", Decimal("5"))] * 3


def test_billing_ledger_equals_sum_of_branches(spark):
    from meterlens.plans.billing import actual_costs
    wmh = [_wmh("w", dt.datetime(2000, 3, 1, h), "2.50") for h in range(4)]
    pipes = [dict(pipe_name="p", start_time=dt.datetime(2000, 3, 2), end_time=dt.datetime(2000, 3, 2, 1),
                  credits_used=D("1.00"))]
    empty = {k: [] for k in ["automatic_clustering_history", "materialized_view_refresh_history",
                             "search_optimization_history", "replication_usage_history", "storage_usage"]}
    t = _tables(spark, warehouse_metering_history=wmh, pipe_usage_history=pipes, **empty)
    ledger = REPORTS["billing_ledger"](t, term_start="2000-01-01")
    actual = ledger.filter("measure_type = 'ACTUAL COMPUTE'").agg({"dollars_used": "sum"}).first()[0]
    assert actual == actual_costs(t).agg({"dollars_used": "sum"}).first()[0] == D("44")


def test_heavy_scanners_zero_partitions(spark):
    qh = [_qh(1, partitions_total=0, partitions_scanned=0), _qh(2, partitions_total=10, partitions_scanned=5)]
    out = REPORTS["heavy_scanners"](_tables(spark, query_history=qh), AS_OF).collect()
    assert [(r.user_name, r.avg_pct_scanned) for r in out] == [("u", 0.25)]


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/Los_Angeles"])
def test_reports_do_not_depend_on_session_time_zone(spark, zone):
    import __spark_entry__ as entry
    from conftest import SF001

    names = ["query_volume_by_hour", "warehouse_utilization", "long_tasks", "credits_by_user", "clustering_weekly_avg"]
    base = {n: sorted(map(tuple, entry.queries()[n](spark, SF001).collect())) for n in names}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        other = {n: sorted(map(tuple, entry.queries()[n](spark, SF001).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert other == base


def test_longest_queries_rank_is_global(spark):
    import random

    rnd = random.Random(11)
    qh = [_qh(i, total_elapsed_time=rnd.randrange(1, 10_000), partitions_scanned=rnd.choice([0, 1, 5, 5, 9, 40, 80]),
              start_time=dt.datetime(2024, 2, 1, 10)) for i in range(300)]
    out = REPORTS["longest_queries"](_tables(spark, query_history=qh), AS_OF, n=7).collect()
    by_rank = sorted(qh, key=lambda r: (-r["partitions_scanned"], r["query_id"]))
    rank = {r["query_id"]: i + 1 for i, r in enumerate(by_rank)}
    longest = sorted(qh, key=lambda r: (-r["total_elapsed_time"], r["query_id"]))[:7]
    assert [(r.query_id, r.query_id_int) for r in out] == [(r["query_id"], rank[r["query_id"]]) for r in longest]


def test_reports_do_not_depend_on_ansi_mode(spark):
    import __spark_entry__ as entry
    from conftest import SF001

    names = ["cost_per_query", "spill_ratio", "cache_usage", "warehouse_over_7day_avg", "usage_forecast",
             "most_scanned_queries", "longest_queries", "statement_timeouts"]
    before = spark.conf.get("spark.sql.ansi.enabled")
    runs = {}
    try:
        for mode in ["true", "false"]:
            spark.conf.set("spark.sql.ansi.enabled", mode)
            runs[mode] = {n: sorted(map(tuple, entry.queries()[n](spark, SF001).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert runs["true"] == runs["false"]


# ---- numbers keep their precision -----------------------------------------------------------------

def test_small_credits_add_up(spark):
    rows = [_wmh("w", dt.datetime(2024, 2, 1, i % 24), "0.0045") for i in range(1000)]
    t = _tables(spark, warehouse_metering_history=rows)
    assert REPORTS["credits_by_warehouse_all"](t).first().credits_used_compute_sum == D("4.5")
    assert REPORTS["credits_by_warehouse_recent"](t, dt.datetime(2024, 2, 3)).first().credits_used_compute_sum == D("4.5")
    day = dict(credits_used=D("0.0045"), start_time=dt.datetime(2024, 2, 1), end_time=dt.datetime(2024, 2, 1, 1), pipe_name="p")
    out = REPORTS["pipe_cost_daily"](_tables(spark, pipe_usage_history=[day] * 1000), AS_OF).first()
    assert out.credits_used == D("4.5")


def test_tiny_cloud_credits_and_queued_load_survive(spark):
    row = _wmh("w", dt.datetime(2024, 2, 1), "1") | {"credits_used_cloud_services": D("0.0004")}
    out = REPORTS["cloud_services_ratio"](_tables(spark, warehouse_metering_history=[row]), AS_OF).collect()
    assert [(r.warehouse_name, r.credits_used_cloud_services) for r in out] == [("w", D("0.0004"))]
    load = dict(warehouse_name="w", start_time=dt.datetime(2024, 2, 1), avg_running=D("0.25"), avg_queued_load=D("0.004"))
    out = REPORTS["queue_pressure"](_tables(spark, warehouse_load_history=[load]), AS_OF).collect()
    assert [(r.sum_running, r.sum_queued) for r in out] == [(D("0.25"), D("0.004"))]


def test_products_with_prices_keep_their_scale(spark):
    from pyspark.sql import types as T

    t = _tables(spark, warehouse_metering_history=[_wmh("w", dt.datetime(2024, 2, 1), "0.123456789")], query_history=[_qh(1)])
    cost = REPORTS["cost_per_query"](t, AS_OF, credit_price=4.25)
    kinds = {f.name: f.dataType for f in cost.schema}
    assert kinds["credits_used_last_month"] == T.DecimalType(28, 9) and kinds["credit_cost_last_month"].scale >= 11
    assert cost.first().credit_cost_last_month == D("0.123456789") * D("4.25")
    from meterlens.plans.billing import actual_costs

    empty = {k: [] for k in ["pipe_usage_history", "automatic_clustering_history", "materialized_view_refresh_history",
                             "search_optimization_history", "replication_usage_history", "storage_usage"]}
    lines = actual_costs(_tables(spark, warehouse_metering_history=[_wmh("w", dt.datetime(2024, 2, 1), "0.123456789")], **empty))
    assert lines.schema["dollars_used"].dataType == T.DecimalType(38, 11)
    total = lines.groupBy().sum("dollars_used")
    assert total.schema[0].dataType.scale == 11 and total.first()[0] == D("0.493827156")


@pytest.mark.parametrize("days", [[], [5]])
def test_usage_forecast_without_a_line(spark, days):
    wmh = [_wmh("w", dt.datetime(2000, 1, 1 + d, 5), "10") for d in days]
    empty = {k: [] for k in ["pipe_usage_history", "automatic_clustering_history", "materialized_view_refresh_history",
                             "search_optimization_history", "replication_usage_history", "storage_usage"]}
    out = REPORTS["usage_forecast"](_tables(spark, warehouse_metering_history=wmh, **empty), term_start="2000-01-01")
    rows = out.collect()
    assert len(rows) == 366 and all(r.forecasted_dollars_used is None for r in rows)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


# ---- SELECT * keeps every column ------------------------------------------------------------------

@pytest.mark.parametrize("report,table,row,params", [
    ("full_scan_queries", "query_history", dict(partitions_scanned=100, partitions_total=100), {"as_of": AS_OF}),
    ("failed_tasks", "task_history", dict(task_id=1, state="FAILED", query_start_time=AS_OF, completed_time=AS_OF), {"as_of": AS_OF}),
    ("long_tasks", "task_history", dict(task_id=1, state="SUCCEEDED", query_start_time=AS_OF, completed_time=AS_OF), {"as_of": AS_OF}),
    ("idle_users", "users", dict(name="u", last_success_login=dt.datetime(2020, 1, 1)), {"as_of": AS_OF}),
    ("users_never_logged_in", "users", dict(name="u"), {}),
    ("idle_roles", "roles", dict(name="r9"), {"as_of": AS_OF}),
    ("idle_warehouses", "warehouses", dict(name="w9"), {"as_of": AS_OF}),
    ("stale_streams", "streams", dict(name="s", stale=True), {}),
])
def test_undeclared_columns_come_back(spark, report, table, row, params):
    from pyspark.sql import functions as F

    base = {"query_history": [_qh(1)], "warehouse_metering_history": [], table: [_qh(2, **row) if table == "query_history" else row]}
    frames = {n: _table(spark, n, r) for n, r in base.items()}
    frames[table] = conform(frames[table].withColumn("e-mail", F.lit("a@b")).withColumn("n", F.lit(7)), table)
    out = REPORTS[report](Tables(frames), **params)
    assert {"e-mail", "n"} <= set(out.columns)
    got = out.first()
    assert got["e-mail"] == "a@b" and got["n"] == 7


def test_save_keeps_precision_and_columns(spark):
    import tempfile

    from pyspark.sql import functions as F

    wmh = _table(spark, "warehouse_metering_history", [_wmh("w", dt.datetime(2024, 2, 1), "0.123456789")])
    root = tempfile.mkdtemp(prefix="meterlens-exact-")
    Tables({"warehouse_metering_history": wmh.withColumn("note", F.lit("x"))}).save(root)
    back = Tables.from_parquet(spark, root, ["warehouse_metering_history"])["warehouse_metering_history"].first()
    assert back.credits_used == D("0.123456789") and back.note == "x"


# ---- row order of the reports that promise one ----------------------------------------------------

ORDERED = {
    "credits_by_warehouse_all": ["-credits_used_compute_sum", "warehouse_name"],
    "credits_by_warehouse_recent": ["-credits_used_compute_sum", "warehouse_name"],
    "credits_by_hour_of_day": ["start_hour", "warehouse_name"], "query_volume_by_hour": ["-query_start_hour", "warehouse_name"],
    "cloud_services_ratio": ["-percent_cloud_services"], "warehouse_over_7day_avg": ["-pct_over_to_7_day_average"],
    "cost_per_query": ["-cost_per_query", "warehouse_name"], "credits_by_user": ["-approximate_credits_used"],
    "credits_by_client": ["-approximate_credits_used"], "most_expensive_queries": ["-relative_performance_cost", "query_id"],
    "most_expensive_queries_recent": ["-relative_performance_cost", "query_id"],
    "frequent_queries": ["-number_of_queries", "query_text"], "longest_queries": ["-query_execution_time_seconds", "query_id"],
    "most_scanned_queries": ["query_id_int"], "full_scan_users": ["-count_of_queries", "user_name"],
    "full_scan_queries": ["-partitions_scanned", "query_id"], "heavy_scanners": ["-avg_pct_scanned"],
    "top_remote_spillers": ["-bytes_spilled_to_remote_storage", "query_id"], "spill_ratio": ["-spilling_read_ratio"],
    "cache_usage": ["percent_scanned_from_cache"], "role_segmentation": ["-roles_per_warehouse", "warehouse_name", "role_name"],
    "usage_forecast": ["consumption_date"], "clustering_cost_daily": ["-date"], "mview_cost_daily": ["-credits_used"],
    "search_opt_cost_daily": ["-credits_used"], "pipe_cost_daily": ["-credits_used"], "replication_cost_daily": ["-credits_used"],
    "clustering_weekly_avg": ["week"], "mview_weekly_avg": ["week"], "search_opt_weekly_avg": ["week"],
    "pipe_weekly_avg": ["week"], "replication_weekly_avg": ["week"], "long_tasks": ["-duration_seconds", "task_id"],
    "failed_tasks": ["-query_start_time", "task_id"], "statement_timeouts": ["object"],
    "ingest_daily": ["database_name", "schema_name", "table_name", "load_date", "status", "ingest_method"],
}


@pytest.mark.parametrize("report", sorted(ORDERED))
def test_rows_come_in_order(spark, report):
    import functools

    import __spark_entry__ as entry
    from conftest import SF01, SF001

    keys = [(k.lstrip("-"), k.startswith("-")) for k in ORDERED[report]]
    folder = SF01 if report == "frequent_queries" else SF001  # no text is frequent in the smallest data
    rows = [tuple(r[k] for k, _ in keys) for r in entry.queries()[report](spark, folder).collect()]

    def compare(a, b):
        for x, y, (_, falling) in zip(a, b, keys):
            if x != y:
                if x is None or y is None:  # nulls last where falling, first where rising
                    return 1 if (x is None) == falling else -1
                return (1 if x > y else -1) * (-1 if falling else 1)
        return 0

    assert rows and rows == sorted(rows, key=functools.cmp_to_key(compare))
