"""The shared operators at work on whole telemetry tables, beyond what the reports need of them.

Each function takes ``Tables`` and returns a DataFrame; the driver entry
registers them beside the reports, with SQL for the same result.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import hour_start, ts_lit
from ..operators.buckets import bucket_counts
from ..operators.distinct import distinct_counts, distinct_state, merge_states
from ..operators.numbering import global_row_number, shared_path
from ..sources.tables import Tables
from . import audit, consumption, contracts, daily_state, sections

QH, WMH = "query_history", "warehouse_metering_history"
#: What telemetry writes for a query that has not ended.
NO_END = dt.datetime(9999, 12, 31)


def untidy(t: Tables) -> Tables:
    """Telemetry whose log repeats and lacks ids and ends, and whose metering windows are of any length.

    Three queries share an id, sign-ups have none; queries at a first
    partition have no end yet, those at a second end before they start;
    windows last 0 to 105 minutes, so they leave gaps, overlap or are empty.
    """
    k = F.col("partitions_scanned")
    log = t[QH].withColumn("query_id", F.when(F.col("warehouse_name") != "signup", F.floor(F.col("query_id").cast("bigint") / 3).cast("string")))
    log = log.withColumn("end_time", F.when(k == 0, ts_lit(NO_END)).when(k == 1, F.timestamp_add("SECOND", F.lit(-10), F.col("start_time")))
                         .otherwise(F.col("end_time")))
    metering = t[WMH].withColumn("end_time", F.timestamp_add("MINUTE", F.hour("start_time") % 8 * 15, F.col("start_time")))
    return Tables({QH: log, WMH: metering})


def utilization_of_any_windows(t: Tables, as_of: dt.datetime, weeks: int = 1) -> DataFrame:
    """``warehouse_utilization`` over irregular windows and a log with repeated ids and missing ends."""
    return consumption.warehouse_utilization(untidy(t), as_of, weeks)


def distinct_users_by_hour(t: Tables) -> DataFrame:
    """Distinct users, queries and execution time per warehouse and hour, from the merged states of failed and other queries."""
    log = t[QH].select("warehouse_name", hour_start(F.col("start_time")).alias("hour"), "user_name", "execution_time", "error_code")
    keys = ["warehouse_name", "hour"]
    parts = [distinct_state(log.filter(c), keys, "user_name", ["execution_time"])
             for c in (F.col("error_code").isNull(), F.col("error_code").isNotNull())]
    state = merge_states(parts, keys, "user_name", ["execution_time"])
    return (distinct_counts(state, keys, "user_name", ["execution_time"], name="users").withColumnRenamed("rows", "queries"))


def numbered_query_log(t: Tables) -> DataFrame:
    """Every query with its place among all by execution time, longest first."""
    log = t[QH].select("query_id", "warehouse_name", "execution_time")
    return global_row_number(log, [F.col("execution_time").desc_nulls_last(), F.col("query_id")], name="place")


def queries_by_role_ranges(t: Tables, warehouse: str) -> DataFrame:
    """Queries of one warehouse in time ranges that come from the log: per warehouse and role, from its shortest query to the middle.

    The ranges overlap and leave gaps; the log is read once for the counts.
    """
    log = t[QH].select("query_id", "warehouse_name", "role_name", "total_elapsed_time")
    ms = F.col("total_elapsed_time")
    ranges = log.groupBy("warehouse_name", "role_name").agg(F.min(ms).alias("low"), F.floor((F.min(ms) + F.max(ms)) / 2).alias("high"))
    edges = ranges.select(F.concat_ws("/", "warehouse_name", "role_name").alias("label"), "low", "high")
    found = bucket_counts(log, (F.col("warehouse_name") == warehouse) & (ms > 0), value="total_elapsed_time", row_id="query_id", edges=edges,
                          rest=("no range", -1), label="time_range")
    return found.withColumnRenamed("_lower", "low")


def quarter_contracts(t: Tables) -> DataFrame:
    """A contract per warehouse, role and quarter of replication: overlapping terms that follow the data."""
    usage = t["replication_usage_history"].select("database_name", F.to_date("start_time").alias("d"), "credits_used")
    terms = usage.groupBy("database_name", F.date_trunc("quarter", "d").cast("date").alias("q")).agg(
        F.min("d").alias("term_start"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("credits_used").alias("c"))
    # Terms run on for as many days as the quarter had rows, modulo 120, so that neighbours overlap by different lengths.
    return terms.select(
        F.concat_ws("/", "database_name", F.col("q").cast("string")).alias("contract_id"), "term_start",
        F.date_add("last", (F.col("n") % 120).cast("int")).alias("term_end"), F.lit("4.00").cast("decimal(10,2)").alias("credit_price"),
        F.col("c").cast("decimal(18,2)").alias("term_amount"))


def contracted_by_day(t: Tables) -> DataFrame:
    """Contracts in force and what they commit, per day."""
    return contracts.contracted_by_day(quarter_contracts(t))


def ledger_from_daily_state(t: Tables, first: dt.date, last: dt.date) -> DataFrame:
    """Totals per service of the days from ``first`` to ``last``, from a state stored in two refreshes that overlap by a week."""
    any_table = t[WMH]
    path = shared_path(any_table, "daily-costs")
    days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    middle = len(days) // 2
    daily_state.refresh(t, path, days[:middle])
    daily_state.refresh(t, path, days[max(0, middle - 7):])
    return daily_state.ledger_totals(daily_state.read_state(any_table.sparkSession, path, first, last))


def account_timeouts(t: Tables) -> DataFrame:
    """Statement timeouts set for the account."""
    return audit.timeout_listing(t, "ACCOUNT")


def warehouse_timeouts(t: Tables) -> DataFrame:
    """Statement timeouts set for warehouses."""
    return audit.timeout_listing(t, "WAREHOUSE")


def user_timeouts(t: Tables) -> DataFrame:
    """Statement timeouts set for users."""
    return audit.timeout_listing(t, "USER")


def grouped_section(t: Tables, as_of: dt.datetime) -> DataFrame:
    """All grouped reports from one scan of each table and lookback class, one row a group: report, its keys as text, its first figure."""
    found = sections.grouped_reports(t, sections.GROUPED, as_of)
    parts = []
    for name, df in found.items():
        keys = list(sections.GROUPED[name][1](as_of)[1].keys)
        value = next(c for c in df.columns if c not in keys)
        parts.append(df.select(F.lit(name).alias("report"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("keys"),
                               F.col(value).cast("double").alias("figure")))
    return reduce(DataFrame.union, parts)


APPLIED = {f.__name__: f for f in (
    utilization_of_any_windows, distinct_users_by_hour, numbered_query_log, queries_by_role_ranges, contracted_by_day,
    ledger_from_daily_state, account_timeouts, warehouse_timeouts, user_timeouts, grouped_section)}
