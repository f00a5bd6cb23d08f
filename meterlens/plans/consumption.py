"""Metering and consumption (family C): where credits go and how busy compute is."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import client_family
from ..functions.time import add_months, as_datetime, hour_start, next_midnight_or_same, start_of_day, ts_lit
from ..operators.allocate import allocate_by_share
from ..operators.overlap import overlap_split
from ..sources.tables import Tables

WMH, QH = "warehouse_metering_history", "query_history"


def credits_by_warehouse_all(t: Tables) -> DataFrame:
    """Compute credits per warehouse over all metering history; largest first."""
    return (t[WMH].groupBy("warehouse_name")
            .agg(F.sum("credits_used_compute").alias("credits_used_compute_sum"))
            .orderBy(F.col("credits_used_compute_sum").desc(), "warehouse_name"))


def credits_by_warehouse_recent(t: Tables, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Compute credits per warehouse over the last ``days``; largest first."""
    cut = as_datetime(as_of) - dt.timedelta(days=days)
    return (t.since(WMH, cut).groupBy("warehouse_name")
            .agg(F.sum("credits_used_compute").alias("credits_used_compute_sum"))
            .orderBy(F.col("credits_used_compute_sum").desc(), "warehouse_name"))


def credits_by_hour_of_day(t: Tables, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Mean compute credits per hour of day and warehouse (real warehouses only)."""
    cut = as_datetime(as_of) - dt.timedelta(days=days)
    return (t.since(WMH, cut).filter(F.col("warehouse_id") > 0)
            .groupBy(F.hour("start_time").cast("bigint").alias("start_hour"), "warehouse_name")
            .agg(F.avg("credits_used_compute").cast("double").alias("credits_used_compute_avg"))
            .orderBy("start_hour", "warehouse_name"))


def query_volume_by_hour(t: Tables, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Number of queries per clock hour and warehouse; newest hour first."""
    cut = as_datetime(as_of) - dt.timedelta(days=days)
    return (t.since(QH, cut)
            .groupBy(hour_start(F.col("start_time")).alias("query_start_hour"), "warehouse_name")
            .agg(F.count(F.lit(1)).alias("num_queries"))
            .orderBy(F.col("query_start_hour").desc(), "warehouse_name"))


def cloud_services_ratio(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Cloud-services share of credits per warehouse, for metering rows with cloud credits."""
    cut = next_midnight_or_same(add_months(as_datetime(as_of), -months))
    out = (t.since(WMH, cut).filter(F.col("credits_used_cloud_services") > 0).groupBy("warehouse_name").agg(
        F.sum("credits_used").alias("credits_used"),
        F.sum("credits_used_cloud_services").alias("credits_used_cloud_services"),
    ))
    ratio = F.try_divide(F.col("credits_used_cloud_services").cast("double"), F.col("credits_used").cast("double"))
    return out.withColumn("percent_cloud_services", ratio).orderBy(
        F.col("percent_cloud_services").desc_nulls_last(), "warehouse_name")


def warehouse_over_7day_avg(t: Tables, rows: int = 7, min_credits: float = 100, min_pct: float = 0.5) -> DataFrame:
    """Warehouse-days whose credits exceed the trailing mean of ``rows`` + 1 days.

    The mean is a row frame (the ``rows`` preceding days that have metering,
    plus the day itself), not a calendar window.  ``min_pct`` is in percent.
    The window partitions per warehouse over at most one row per day.
    """
    daily = t[WMH].groupBy(F.to_date("start_time").alias("start_date"), "warehouse_name").agg(
        F.sum("credits_used").alias("credits_used_date_wh"))
    frame = Window.partitionBy("warehouse_name").orderBy("start_date").rowsBetween(-rows, 0)
    value = F.col("credits_used_date_wh").cast("double")
    avg = F.avg(value).over(frame)
    out = daily.withColumn("_avg", avg).withColumn("_pct", 100.0 * (F.try_divide(value, F.col("_avg")) - 1))
    out = out.filter((F.col("credits_used_date_wh") > min_credits) & (F.col("_pct") >= min_pct))
    return out.select(
        "start_date", "warehouse_name", "credits_used_date_wh",
        F.col("_avg").alias("credits_used_7_day_avg"),
        F.col("_pct").alias("pct_over_to_7_day_average"),
    ).orderBy(F.col("pct_over_to_7_day_average").desc(), "warehouse_name", "start_date")


def cost_per_query(t: Tables, as_of: dt.datetime, months: int = 1, credit_price: float = 4) -> DataFrame:
    """Credits, dollars and dollars per query for each warehouse over the last month.

    Both sides are aggregated per warehouse before the join, so the join
    sees one row per warehouse on each side.  Credits and dollars keep their
    full scale; only the cost per query is a price in cents.
    """
    cut = start_of_day(add_months(as_datetime(as_of), -months))
    qc = t.since(QH, cut).groupBy("warehouse_name").agg(F.count("query_id").alias("query_count_last_month"))
    wc = t.since(WMH, cut).groupBy("warehouse_name").agg(F.sum("credits_used").alias("credits_used_last_month"))
    price = F.lit(Decimal(str(credit_price))).cast("decimal(10,4)")
    wc = wc.withColumn("credit_cost_last_month", F.col("credits_used_last_month") * price)
    # A warehouse without query ids has no price per query (no division by zero).
    per_query = F.try_divide(F.col("credit_cost_last_month"), F.col("query_count_last_month").cast("decimal(20,0)"))
    out = qc.join(wc, on="warehouse_name", how="inner").withColumn("cost_per_query", per_query.cast("decimal(10,2)"))
    return out.select("warehouse_name", "query_count_last_month", "credits_used_last_month",
                      "credit_cost_last_month", "cost_per_query").orderBy(F.col("cost_per_query").desc_nulls_last(),
                                                                        "warehouse_name")


def _first_hour(as_of, months: int) -> dt.datetime:
    """The hour holding the cut-off: every allocated query starts in it or later."""
    return add_months(as_datetime(as_of), -months).replace(minute=0, second=0, microsecond=0)


def _usage_for_allocation(t: Tables, as_of, months: int) -> DataFrame:
    cut = add_months(as_datetime(as_of), -months)
    usage = (t.since(QH, cut, strict=True)
             .filter(F.col("warehouse_name").isNotNull() & (F.col("execution_time") > 0))
             .select("user_name", "session_id", "warehouse_name",
                     hour_start(F.col("start_time")).alias("hour"), "execution_time"))
    # Implied by the cut; stated so that the bound Spark infers from the
    # bounded metering join is already present in every branch that reads
    # this frame (identical branches share one shuffle stage).
    return usage.filter(F.col("hour") >= ts_lit(_first_hour(as_of, months)))


def _hour_cost(t: Tables, as_of, months: int) -> DataFrame:
    """Metering of the hours the allocated queries can start in (earlier
    metering is never joined, so it is not read)."""
    return t.since(WMH, _first_hour(as_of, months)).select(
        "warehouse_name", F.col("start_time").alias("hour"), "credits_used")


def credits_by_user(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Approximate credits per user and warehouse.

    Each warehouse-hour's credits are split over users in proportion to
    their summed execution time in that hour.
    """
    usage = _usage_for_allocation(t, as_of, months)
    out = allocate_by_share(usage, _hour_cost(t, as_of, months), who="user_name", slot=["warehouse_name", "hour"],
                            weight="execution_time", cost_col="credits_used", out_col="approximate_credits_used")
    return out.orderBy(
        F.col("approximate_credits_used").desc(), "user_name", "warehouse_name")


def credits_by_client(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Approximate credits per client application family and warehouse.

    The query log is first summed per (session, warehouse, hour), so the
    join with sessions sees one row per session-hour instead of one per
    query; then the same proportional split as ``credits_by_user``.
    """
    usage = _usage_for_allocation(t, as_of, months)
    per_session = usage.groupBy("session_id", "warehouse_name", "hour").agg(
        F.sum("execution_time").alias("execution_time"))
    sessions = t["sessions"].select("session_id", "client_application_id")
    named = per_session.join(sessions, on="session_id", how="inner").select(
        client_family(F.col("client_application_id")).alias("client_application_name"),
        "warehouse_name", "hour", "execution_time")
    out = allocate_by_share(named, _hour_cost(t, as_of, months), who="client_application_name",
                            slot=["warehouse_name", "hour"],
                            weight="execution_time", cost_col="credits_used", out_col="approximate_credits_used")
    return out.orderBy(
        F.col("approximate_credits_used").desc(), "client_application_name", "warehouse_name")


def warehouse_utilization(t: Tables, as_of: dt.datetime, weeks: int = 1) -> DataFrame:
    """Per warehouse and metering window: credits, seconds spent executing and queries touching it.

    Queries that cross the edges of a metering window are split across the
    windows they overlap (closed at both ends).  Contained queries count
    their execution time; split ones count wall-clock seconds.  Queries are
    counted by distinct id, separately as contained, ending, starting or
    passing through.  Only queries *started* in the lookback are considered.
    Windows are metering's own, from start to end, whatever their length.
    """
    cut = next_midnight_or_same(as_datetime(as_of) - dt.timedelta(weeks=weeks))
    metering = t.since(WMH, cut).select("warehouse_name", "start_time", "end_time", "credits_used")
    queries = t.since(QH, cut).select("query_id", "warehouse_name", "start_time", "end_time", "execution_time")
    per_window = overlap_split(queries, metering, key="warehouse_name").select(
        "warehouse_name", "start_time",
        (F.coalesce(F.col("contained_ms"), F.lit(0)) / 1000 + F.coalesce(F.col("partial_seconds"), F.lit(0)))
        .alias("_seconds"), "ids")
    joined = metering.join(per_window, on=["warehouse_name", "start_time"], how="left")
    return joined.groupBy("warehouse_name", "start_time", "credits_used").agg(
        F.sum(F.coalesce(F.col("_seconds"), F.lit(0.0))).alias("total_execution_time_seconds"),
        F.sum(F.coalesce(F.col("ids"), F.lit(0))).cast("bigint").alias("query_count"),
    )
