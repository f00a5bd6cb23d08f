"""Inventory snapshots: the newest at or before a moment is read, other files are never opened."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from meterlens import REPORTS, Tables
from meterlens.sources.inventory import File, InventoryReader, inventory_tables, read_inventory

HEAD = "name,size,auto_suspend,auto_resume,resource_monitor,comment\n"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))
    path = tmp_path_factory.mktemp("inventory")
    for name in ("warehouses", "streams", "parameters"):
        (path / name).mkdir()
    (path / "warehouses/2024-01-01T00-00-00.csv").write_text(HEAD + "old,Small,60,true,null,x\n")
    (path / "warehouses/2024-02-01T06-30-00.csv").write_text(HEAD + 'w1,X-Small,0,false,null,"a, b"\nw2,Large,,true,rm,\n')
    (path / "warehouses/part-2024-02-01T06-30-00-2.csv").write_text(HEAD + "w3,Large,7200,true,null,\n")
    (path / "warehouses/2024-03-01T00-00-00.csv").write_text("not,a,listing\n1,2,3\n")
    (path / "warehouses/readme.txt").write_text("nothing")
    (path / "streams/2024-02-01T00-00-00.json").write_text(json.dumps([{"name": "s1", "stale": True}, {"name": "s2", "stale": "false"}]))
    (path / "parameters/2024-02-01T00-00-00.jsonl").write_text(
        '{"Name": "STATEMENT_TIMEOUT_IN_SECONDS", "LEVEL": "ACCOUNT", "object": "acme", "value": 100}\n\n'
        '{"Name": "STATEMENT_TIMEOUT_IN_SECONDS", "LEVEL": "USER", "object": "u", "value": "30"}\n')
    return str(path)


def test_newest_at_or_before(spark, folder):
    moment = dt.datetime(2024, 2, 1, 6, 30)
    got = read_inventory(spark, folder, "warehouses", moment)
    assert sorted(map(tuple, got.collect())) == [
        ("w1", "X-Small", 0, "false", "null", moment), ("w2", "Large", None, "true", "rm", moment), ("w3", "Large", 7200, "true", "null", moment)]
    early = read_inventory(spark, folder, "warehouses", moment - dt.timedelta(seconds=1))
    assert [r.name for r in early.collect()] == ["old"]
    assert read_inventory(spark, folder, "warehouses", dt.datetime(2020, 1, 1)).count() == 0
    assert read_inventory(spark, folder + "/nowhere", "streams").count() == 0
    assert read_inventory(spark, "file://" + folder, "streams").count() == 2
    with pytest.raises(Exception, match="lacks"):
        read_inventory(spark, folder, "warehouses").collect()  # the newest of all is no listing
    with pytest.raises(Exception, match="listing must be"):
        read_inventory(spark, folder, "roles")


def test_filters_prune_snapshots(spark, folder):
    every = read_inventory(spark, folder, "warehouses", dt.datetime(2024, 2, 20), snapshots="all")
    assert every.groupBy("snapshot_time").count().count() == 2
    late = read_inventory(spark, folder, "warehouses", snapshots="all").filter(F.col("snapshot_time") < F.lit("2024-03-01").cast("timestamp_ntz"))
    assert late.count() == 4  # the broken file of March is not opened
    assert late.filter("name = 'w1'").select("size").collect()[0][0] == "X-Small"


def test_files_are_partitions(folder):
    reader = InventoryReader("warehouses", folder, dt.datetime(2024, 2, 20), every=False)
    files = reader.partitions()
    assert all(isinstance(f, File) for f in files) and [os.path.basename(f.value) for f in files] == [
        "2024-02-01T06-30-00.csv", "part-2024-02-01T06-30-00-2.csv"]


def test_reports_over_an_inventory(spark, folder):
    t = Tables(inventory_tables(spark, folder, dt.datetime(2024, 2, 15)))
    assert [r.warehouse_name for r in REPORTS["no_auto_resume"](t).collect()] == ["w1"]
    assert sorted(r.warehouse_name for r in REPORTS["no_auto_suspend"](t).collect()) == ["w1", "w2"]
    assert [r.name for r in REPORTS["stale_streams"](t).collect()] == ["s1"]
    assert {(r.object, r.effective_seconds) for r in REPORTS["statement_timeouts"](t).collect()} == {("acme", 100), ("u", 30)}
