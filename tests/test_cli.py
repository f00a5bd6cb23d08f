"""Running reports from stored telemetry: the section runner and the command line."""

import datetime as dt
import os
import tempfile

from conftest import SF001
from meterlens import REPORTS, Tables, driver_tables
from meterlens.__main__ import main
from meterlens.plans.catalog import SECTIONS, run_section


def test_every_report_is_in_a_section():
    from meterlens.plans.catalog import TIERS

    assert {k for keys in SECTIONS.values() for k in keys} == set(REPORTS)
    assert set(TIERS) == set(REPORTS)
    assert list(TIERS.values()).count(1) == 15 and list(TIERS.values()).count(None) == 1


def test_section_runner_and_cli(spark):
    root = tempfile.mkdtemp(prefix="meterlens-store-")
    names = ["query_history", "warehouse_metering_history", "users", "roles", "warehouses", "parameters",
             "streams", "task_history", "sessions"]
    bridge = driver_tables(spark, SF001)
    Tables({n: bridge[n] for n in names}).save(root)
    t = Tables.from_parquet(spark, root, names)
    reports = run_section(t, "setup", as_of=dt.datetime(2024, 2, 15))
    assert set(reports) == set(SECTIONS["setup"]) and reports.skipped == {}
    usage = run_section(t, "usage", as_of=dt.datetime(2024, 2, 15))
    # Left out, and said so: one lacks its warehouse, one a table.
    assert set(usage.skipped) == {"execution_time_buckets", "usage_forecast"}
    assert "needs ['warehouse']" in usage.skipped["execution_time_buckets"]
    assert "is not available" in usage.skipped["usage_forecast"]
    assert set(usage) | set(usage.skipped) == set(SECTIONS["usage"])
    assert usage["credits_by_user"].count() > 0
    out = tempfile.mkdtemp(prefix="meterlens-out-")
    assert main(["--section", "setup", "--tables", root, "--as-of", "2024-02-15", "--out", out]) == 0
    assert sorted(os.listdir(out)) == sorted(SECTIONS["setup"])
    back = spark.read.parquet(f"{out}/idle_roles").collect()
    assert sorted(r.name for r in back) == sorted(r.name for r in REPORTS["idle_roles"](t, dt.datetime(2024, 2, 15))
                                                  .collect())


def test_cli_reports_what_it_skips(spark, capsys):
    import pytest

    root, out = tempfile.mkdtemp(prefix="meterlens-store-"), tempfile.mkdtemp(prefix="meterlens-out-")
    bridge = driver_tables(spark, SF001)
    Tables({"query_history": bridge["query_history"]}).save(root)
    code = main(["--section", "usage", "--tier", "2", "--tables", root, "--as-of", "2024-02-15", "--out", out])
    assert code == 1 and "skipped execution_time_buckets" in capsys.readouterr().err
    with pytest.raises(ValueError, match="min_cuont"):
        main(["frequent_queries", "--tables", root, "--as-of", "2024-02-15", "--out", out, "--param", "min_cuont=9"])


def test_cli_with_one_scan_and_an_inventory(spark, tmp_path):
    root, out, listings = (str(tmp_path / n) for n in ("store", "out", "listings"))
    bridge = driver_tables(spark, SF001)
    names = ["query_history", "warehouse_metering_history", "warehouse_load_history", "users", "roles", "task_history"]
    Tables({n: bridge[n] for n in names}).save(root)
    main(["--section", "performance", "--tables", root, "--as-of", "2024-02-15", "--out", out, "--one-scan"])
    def rows(df):  # means may differ in their last digit with the order of summation
        return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())

    single = run_section(bridge, "performance", dt.datetime(2024, 2, 15))
    for name in ("cache_usage", "full_scan_users", "heavy_scanners"):
        assert rows(spark.read.parquet(f"{out}/{name}")) == rows(single[name])
    os.makedirs(f"{listings}/warehouses")
    with open(f"{listings}/warehouses/2024-02-01T00-00-00.csv", "w") as f:
        f.write("name,size,auto_suspend,auto_resume,resource_monitor\nw1,Small,0,false,null\n")
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), here]))
    assert main(["no_auto_resume", "--tables", root, "--inventory", listings, "--as-of", "2024-02-15", "--out", out]) == 0
    assert [r.warehouse_name for r in spark.read.parquet(f"{out}/no_auto_resume").collect()] == ["w1"]


def test_cli_values_follow_the_parameter():
    from meterlens.__main__ import _value

    assert _value("execution_time_buckets", "warehouse", "123") == "123"
    assert _value("frequent_queries", "min_count", "12") == 12
    assert _value("spill_ratio", "factor", "2.5") == 2.5
    assert _value("billing_ledger", "credit_price", "4.10") == "4.10"  # a price stays exact


def test_validate_names_schema_problems(spark):
    import pytest

    good = driver_tables(spark, SF001)
    good.validate(["query_history", "users"])
    bad = Tables({"users": spark.createDataFrame([("a", [1])], "name string, last_success_login array<int>")})
    with pytest.raises(ValueError, match="users.last_success_login: array<int>.*users.deleted_on: missing"):
        bad.validate()


def test_validate_refuses_types_that_a_cast_would_cut(spark):
    import pytest

    wide = good = driver_tables(spark, SF001)["warehouse_metering_history"]
    for kind in ("decimal(38,12)", "double", "decimal(38,9)"):
        bad = Tables({"warehouse_metering_history": wide.withColumn("credits_used", wide.credits_used.cast(kind))})
        with pytest.raises(ValueError, match="warehouse_metering_history.credits_used"):
            bad.validate()
    bad = Tables({"warehouse_metering_history": wide.withColumn("warehouse_id", wide.warehouse_id.cast("bigint"))})
    with pytest.raises(ValueError, match="warehouse_id: bigint is not int"):
        bad.validate()
    Tables({"warehouse_metering_history": good.withColumn("credits_used", good.credits_used.cast("decimal(11,2)"))}).validate()


def test_repeated_ids(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "query_id string")
    assert [tuple(r) for r in Tables({"query_history": df}).repeated_ids().collect()] == [("a", 2)]


def test_from_parquet_accepts_utc_timestamps(spark):
    from pyspark.sql import functions as F

    root = tempfile.mkdtemp(prefix="meterlens-ltz-")
    qh = driver_tables(spark, SF001)["query_history"]
    (qh.withColumn("start_time", F.col("start_time").cast("timestamp"))
       .withColumn("end_time", F.col("end_time").cast("timestamp"))
       .write.parquet(f"{root}/query_history"))
    t = Tables.from_parquet(spark, root, ["query_history"])
    t.validate()
    got = sorted(map(tuple, REPORTS["query_volume_by_hour"](t, dt.datetime(2024, 1, 31)).collect()))
    want = sorted(map(tuple, REPORTS["query_volume_by_hour"](driver_tables(spark, SF001),
                                                             dt.datetime(2024, 1, 31)).collect()))
    assert got == want


def test_bounded_readers_equal_filtering_the_whole_table(spark):
    from pyspark.sql import functions as F

    t = driver_tables(spark, SF001)
    plain = Tables({n: t[n] for n in ["warehouse_metering_history", "warehouse_load_history", "storage_usage"]})
    cuts = [(dt.datetime(2024, 1, 15, 0, 30), None, False), (dt.datetime(2024, 1, 15), None, True),
            (dt.datetime(2024, 1, 10, 7, 0, 0, 1), dt.datetime(2024, 1, 20, 3, 15), False)]
    for name in ["warehouse_metering_history", "warehouse_load_history"]:
        for lo, hi, strict in cuts:
            a = sorted(map(tuple, t.between(name, lo, hi, strict=strict).collect()))
            b = sorted(map(tuple, plain.between(name, lo, hi, strict=strict).collect()))
            assert a == b and a, (name, lo, hi, strict)
    lo, hi = dt.datetime(1998, 3, 1, 12), dt.datetime(1998, 6, 2, 1)
    a = sorted(map(tuple, t.between("storage_usage", lo, hi).collect()))
    b = sorted(map(tuple, plain.between("storage_usage", lo, hi).collect()))
    assert a == b and a
    plan = t.since("warehouse_metering_history", dt.datetime(2024, 1, 15))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-15T00:00)" in plan


def test_output_and_link_helpers(spark):
    from decimal import Decimal

    from pyspark.sql import functions as F

    from meterlens.functions import QUERY_DETAIL_URL, to_output, url_for_query

    df = spark.createDataFrame([(Decimal("1.50"), "q1", 3)], "c decimal(18,2), id string, n int")
    out = to_output(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["double", "string", "int"]
    link = df.select(url_for_query(QUERY_DETAIL_URL, F.col("id"), account="acct").alias("u")).first().u
    assert link.startswith("https://acct.") and link.endswith("queryId=q1")


def test_run_report_parameters(spark):
    import pytest

    from meterlens.plans.catalog import run_report

    t = driver_tables(spark, SF001)
    with pytest.raises(ValueError, match="needs as_of"):
        run_report(t, "idle_roles")
    with pytest.raises(ValueError, match="warehouse"):
        run_report(t, "execution_time_buckets", dt.datetime(2024, 1, 31))
    df = run_report(t, "execution_time_buckets", dt.datetime(2024, 1, 31), warehouse="view")
    assert df.count() == 8
    with pytest.raises(ValueError, match="unused"):
        run_report(t, "execution_time_buckets", dt.datetime(2024, 1, 31), warehouse="view", unused=1)
    with pytest.raises(ValueError, match="min_cuont"):
        run_section(t, "usage", as_of=dt.datetime(2024, 1, 31), min_cuont=99)
    assert run_section(t, "usage", as_of=dt.datetime(2024, 1, 31), min_count=2, warehouse="view").skipped == {}


def test_save_and_read_back_every_table(spark):
    from meterlens.sources.tables import PARTITIONING, SCHEMAS

    bridge = driver_tables(spark, SF001)
    lo, hi = dt.datetime(2000, 1, 1), dt.datetime(2000, 2, 1)
    events_based = {"query_history", "warehouse_metering_history", "warehouse_load_history", "task_history"}

    def piece(name):
        if name in PARTITIONING and name not in events_based:
            return bridge.between(name, lo, hi)
        if name == "storage_usage":
            return bridge.between(name, lo, hi)
        return bridge[name]

    sliced = Tables({name: piece(name) for name in SCHEMAS})
    root = tempfile.mkdtemp(prefix="meterlens-roundtrip-")
    sliced.save(root)
    stored = Tables.from_parquet(spark, root)
    stored.validate()
    for name in SCHEMAS:
        assert sorted(map(repr, map(tuple, stored[name].select(*SCHEMAS[name].names).collect()))) == \
            sorted(map(repr, map(tuple, sliced[name].collect()))), name
    for report, params in [("billing_ledger", {"term_start": "2000-01-01"}), ("ingest_daily", {}),
                           ("credits_by_user", {"as_of": dt.datetime(2024, 2, 15)})]:
        def rows(tables):
            return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r])
                          for r in REPORTS[report](tables, **params).collect())  # noqa: B023

        assert rows(stored) == rows(sliced), report


def test_every_report_is_documented():
    missing = [name for name, fn in REPORTS.items() if not (fn.__doc__ or "").strip()]
    assert missing == []
