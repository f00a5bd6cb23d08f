"""Telemetry derived from the generic benchmark tables.

The test harness only ships TPC-H-like tables plus an ``events`` stream, so
each telemetry table is *derived* from them with Spark (joins, aggregates,
expressions).  The derivation is deterministic and grows with the input:
``events`` becomes the query log, hourly metering and task runs; orders and
line items become serverless histories, storage, loads and users; nations,
regions and suppliers become roles, streams and parameters.

The same rules are written as SQL for the DuckDB oracle (``duckdb_oracle.py``);
both sides must stay in step.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import CLIENT_PREFIXES, TASK_FAILED, TASK_SUCCEEDED, TIMEOUT_PARAMETER
from ..functions.time import hour_start, ts_lit
from .tables import SCHEMAS, Tables, conform

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Client application ids handed to sessions in turn: one of each known
# family (prefix plus a version), one unknown client and one missing id.
FIXTURE_CLIENT_IDS = [prefix + version for (prefix, _), version in
                      zip(CLIENT_PREFIXES, ["1.1", "2", "1.2", "3.13", "2.7", "2.2"])] + ["Custom 1", None]


def _credits(col):
    """Credits with all nine decimals in use: cents of ``col`` times 0.010000123."""
    return (F.round(col * 100).cast("bigint") * F.lit(Decimal("0.010000123"))).cast("decimal(18,9)")


def _plus_seconds(ts, seconds):
    return F.timestamp_add("SECOND", seconds, ts)


def _plus_hour(ts):
    return F.timestamp_add("HOUR", F.lit(1), ts)


class DriverBridge:
    """Builds every telemetry table from the driver tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # events -> query log and friends ----------------------------------
    def _events(self) -> DataFrame:
        return self.read("events").withColumn(
            "cents", F.round(F.col("value") * 100).cast("bigint")
        ).withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("bigint"))

    def query_history(self) -> DataFrame:
        e = self._events()
        size = (F.when(F.col("user_id") % 4 == 0, "xsmall").when(F.col("user_id") % 4 == 1, "Small")
                .when(F.col("user_id") % 4 == 2, "MEDIUM").otherwise("4xlarge"))
        return conform(e.select(
            F.col("event_id").cast("string").alias("query_id"),
            F.concat(F.col("event_type"), F.lit("/"), F.col("k").cast("string")).alias("query_text"),
            F.when(F.col("event_type") == "signup", "CREATE_USER").otherwise("SELECT").alias("query_type"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_name"),
            F.concat(F.lit("role_"), (F.col("user_id") % 7).cast("string")).alias("role_name"),
            F.col("event_type").alias("warehouse_name"),
            size.alias("warehouse_size"),
            F.col("user_id").alias("session_id"),
            F.col("ts").alias("start_time"),
            _plus_seconds(F.col("ts"), F.col("cents")).alias("end_time"),
            (F.col("cents") * 1000).alias("execution_time"),
            (F.col("cents") * 10).alias("total_elapsed_time"),
            F.when(F.col("event_type") == "error", F.lit("1")).alias("error_code"),
            F.col("k").alias("partitions_scanned"),
            F.when(F.col("k") == 0, 0).otherwise(100).alias("partitions_total"),
            (F.col("k") * 1000).alias("bytes_scanned"),
            F.when(F.col("user_id") % 5 == 0, F.col("cents") * 10).otherwise(0)
            .alias("bytes_spilled_to_remote_storage"),
            (F.col("k") / 100).alias("percentage_scanned_from_cache"),
        ), "query_history")

    def _events_between(self, lo, hi) -> DataFrame:
        """Events of every clock hour that can start in [lo, hi): a superset
        bound on the raw timestamp that keeps each such hour whole."""
        e = self.read("events")
        if lo is not None:
            e = e.filter(F.col("ts") >= ts_lit(_floor_hour(lo)))
        if hi is not None:
            e = e.filter(F.col("ts") < ts_lit(_ceil_hour(hi)))
        return e

    def warehouse_metering_history(self, e: DataFrame | None = None) -> DataFrame:
        e = self.read("events") if e is None else e
        value = _credits(F.col("value"))
        cloud = F.col("event_id") % 4 == 0
        hour = hour_start(F.col("ts"))
        return conform(e.groupBy(
            F.when(F.col("event_type") == "error", 0).otherwise(1).alias("warehouse_id"),
            F.col("event_type").alias("warehouse_name"),
            hour.alias("start_time"),
            _plus_hour(hour).alias("end_time"),
        ).agg(
            F.sum(value).alias("credits_used"),
            F.sum(F.when(~cloud, value).otherwise(F.lit(Decimal("0")))).alias("credits_used_compute"),
            # Some warehouses have far less than a cent of cloud credits an hour.
            F.sum(F.when(cloud, F.when(F.col("event_type") == "error", F.lit(Decimal("0.0004"))).otherwise(value))
                  .otherwise(F.lit(Decimal("0")))).alias("credits_used_cloud_services"),
        ), "warehouse_metering_history")

    def warehouse_load_history(self, e: DataFrame | None = None) -> DataFrame:
        e = self.read("events") if e is None else e
        return conform(e.groupBy(
            F.col("event_type").alias("warehouse_name"), hour_start(F.col("ts")).alias("start_time"),
        ).agg(
            (F.count(F.lit(1)) * F.lit(Decimal("0.125"))).alias("avg_running"),
            (F.sum(F.when(F.col("user_id") % 29 == 0, 1).otherwise(0)) * F.lit(Decimal("0.0004"))).alias("avg_queued_load"),
        ), "warehouse_load_history")

    def task_history(self) -> DataFrame:
        e = self._events()
        state = (F.when(F.col("event_type") == "error", TASK_FAILED)
                 .when(F.col("event_type") == "signup", "SKIPPED").otherwise(TASK_SUCCEEDED))
        return conform(e.select(
            F.col("event_id").alias("task_id"), state.alias("state"), F.col("ts").alias("query_start_time"),
            _plus_seconds(F.col("ts"), F.col("cents")).alias("completed_time"),
        ), "task_history")

    def sessions(self) -> DataFrame:
        u = F.col("user_id") % len(FIXTURE_CLIENT_IDS)
        client = F.lit(None).cast("string")
        for i, client_id in reversed(list(enumerate(FIXTURE_CLIENT_IDS))):
            client = F.when(u == i, F.lit(client_id).cast("string")).otherwise(client)
        return conform(self.read("events").select("user_id").distinct().select(
            F.col("user_id").alias("session_id"), client.alias("client_application_id")), "sessions")

    # line items / orders -> serverless histories ------------------------
    def _serverless(self, df, database, schema, table, credits) -> DataFrame:
        return df.select(
            F.col("l_shipdate").alias("start_time"), _plus_hour(F.col("l_shipdate")).alias("end_time"),
            database.alias("database_name"), schema.alias("schema_name"), table.alias("table_name"),
            _credits(credits).alias("credits_used"),
        )

    def automatic_clustering_history(self) -> DataFrame:
        li = self.read("lineitem")
        table = F.concat(F.lit("line_"), F.col("l_linenumber").cast("string"))
        return conform(self._serverless(li, F.col("l_returnflag"), F.col("l_linestatus"), table, F.col("l_quantity")),
                       "automatic_clustering_history")

    def materialized_view_refresh_history(self) -> DataFrame:
        li = self.read("lineitem").join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        return conform(self._serverless(li, F.col("l_returnflag"), F.col("p_type"), F.col("p_brand"), F.col("l_discount")),
                       "materialized_view_refresh_history")

    def search_optimization_history(self) -> DataFrame:
        li = (self.read("lineitem").join(self.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
              .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")))
        return conform(self._serverless(li, F.col("n_name"), F.col("l_linestatus"), F.col("s_name"), F.col("l_tax")),
                       "search_optimization_history")

    def pipe_usage_history(self) -> DataFrame:
        o = self.read("orders")
        return conform(o.select(
            F.col("o_orderpriority").alias("pipe_name"), F.col("o_orderdate").alias("start_time"),
            _plus_hour(F.col("o_orderdate")).alias("end_time"), _credits(F.col("o_totalprice")).alias("credits_used"),
        ), "pipe_usage_history")

    def replication_usage_history(self) -> DataFrame:
        o = (self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
             .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
             .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey")))
        return conform(o.select(
            F.col("r_name").alias("database_name"), F.col("o_orderdate").alias("start_time"),
            _plus_hour(F.col("o_orderdate")).alias("end_time"), _credits(F.col("o_totalprice")).alias("credits_used"),
        ), "replication_usage_history")

    def storage_usage(self, o: DataFrame | None = None) -> DataFrame:
        o = self.read("orders") if o is None else o
        return conform(o.groupBy(F.to_date("o_orderdate").alias("usage_date")).agg(
            (F.sum("o_orderkey").cast("bigint") * 1_000_000).alias("storage_bytes"),
            (F.sum("o_custkey").cast("bigint") * 1_000_000).alias("stage_bytes"),
            (F.count(F.lit(1)).cast("bigint") * 1_000_000).alias("failsafe_bytes"),
        ), "storage_usage")

    def copy_history(self) -> DataFrame:
        o = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return conform(o.select(
            F.col("o_orderdate").alias("last_load_time"), F.col("o_orderstatus").alias("status"),
            F.col("c_mktsegment").alias("table_catalog_name"),
            F.concat(F.lit("nation_"), (F.col("c_nationkey") % 3).cast("string")).alias("table_schema_name"),
            F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("table_name"),
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_orderpriority")).alias("pipe_name"),
            (F.col("o_orderkey") % 1000).alias("row_count"), (F.col("o_orderkey") % 1000 + 1).alias("row_parsed"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("file_size"),
        ), "copy_history")

    # identity and configuration snapshots -------------------------------
    def users(self) -> DataFrame:
        last = self.read("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("m"))
        c = self.read("customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
        return conform(c.select(
            F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("name"),
            F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("m")).alias("last_success_login"),
            F.when(F.col("c_custkey") % 13 == 0, F.col("m")).alias("deleted_on"),
        ), "users")

    def roles(self) -> DataFrame:
        n = self.read("nation")
        return conform(n.select(
            F.concat(F.lit("role_"), F.col("n_nationkey").cast("string")).alias("name"),
            F.when(F.col("n_nationkey") == 9, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("deleted_on"),
        ), "roles")

    def warehouses(self) -> DataFrame:
        names = (self.read("events").select(F.col("event_type").alias("name")).distinct()
                 .withColumn("size", F.lit("Small"))
                 .unionByName(self.read("customer").select(F.col("c_mktsegment").alias("name")).distinct()
                              .withColumn("size", F.lit("Large"))))
        # A per-row number from the name itself drives the settings below.
        b = names.withColumn("i", (F.length("name") + F.ascii("name")).cast("bigint"))
        return conform(b.select(
            "name", "size",
            F.when(F.col("i") % 3 == 0, F.lit(None)).when(F.col("i") % 3 == 1, 0).otherwise(F.col("i") * 1200).alias("auto_suspend"),
            F.when(F.col("i") % 2 == 0, "false").otherwise("true").alias("auto_resume"),
            F.when(F.col("i") % 4 < 2, "null").otherwise("rm_1").alias("resource_monitor"),
        ), "warehouses")

    def streams(self) -> DataFrame:
        s = self.read("supplier")
        return conform(s.select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 5 == 0).alias("stale")), "streams")

    def parameters(self) -> DataFrame:
        s = self.read("supplier")
        r = F.col("s_nationkey") % 3
        level = F.when(r == 0, "ACCOUNT").when(r == 1, "WAREHOUSE").otherwise("USER")
        timeouts = s.select(
            F.lit(TIMEOUT_PARAMETER).alias("name"), level.alias("level"),
            F.col("s_name").alias("object"), (F.col("s_suppkey") % 4 * 600).cast("bigint").alias("value"),
        )
        zones = self.read("region").select(
            F.lit("TIMEZONE").alias("name"), F.lit("ACCOUNT").alias("level"),
            F.col("r_name").alias("object"), F.lit(0).cast("bigint").alias("value"),
        )
        return conform(timeouts.unionByName(zones), "parameters")

    def _orders_between(self, lo, hi) -> DataFrame:
        """Orders of every day that can fall in [lo, hi), whole days kept."""
        o = self.read("orders")
        if lo is not None:
            o = o.filter(F.col("o_orderdate") >= ts_lit(_floor_day(lo)))
        if hi is not None:
            o = o.filter(F.col("o_orderdate") < ts_lit(_ceil_day(hi)))
        return o

    def tables(self) -> Tables:
        # Metering, load history and storage are aggregates whose time column
        # is computed, so a time filter on them cannot reach the raw scan;
        # their bounded readers filter the raw rows first (by whole hours or
        # days, so every qualifying group keeps all its rows).
        bounded = {
            "warehouse_metering_history": lambda lo, hi: self.warehouse_metering_history(self._events_between(lo, hi)),
            "warehouse_load_history": lambda lo, hi: self.warehouse_load_history(self._events_between(lo, hi)),
            "storage_usage": lambda lo, hi: self.storage_usage(self._orders_between(lo, hi)),
        }
        return Tables({name: getattr(self, name) for name in SCHEMAS}, bounded=bounded)


def _floor_hour(t):
    return t.replace(minute=0, second=0, microsecond=0)


def _ceil_hour(t):
    floor = _floor_hour(t)
    return floor if floor == t else floor + dt.timedelta(hours=1)


def _floor_day(t):
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def _ceil_day(t):
    floor = _floor_day(t)
    return floor if floor == t else floor + dt.timedelta(days=1)


def driver_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """``Tables`` whose telemetry is derived from the driver tables in ``sf_dir``."""
    return DriverBridge(spark, sf_dir).tables()
