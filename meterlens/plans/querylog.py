"""Query-log analysis (family D): expensive, frequent, long, scanning and spilling queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import QUERY_DETAIL_URL, QUERY_HISTORY_URL, div0, url_for_query, warehouse_nodes
from ..functions.time import add_months, as_datetime, next_midnight_or_same, start_of_day, ts_lit
from ..operators.buckets import bucket_counts
from ..operators.prefilter import keep_hashes
from ..operators.ranking import rank_among, top_k
from ..sources.tables import Tables, all_columns

QH = "query_history"
_MS_PER = {"seconds": 1000, "minutes": 1000 * 60, "hours": 1000 * 60 * 60}


def _query_url(account: str, query_id) -> F.Column:
    return url_for_query(QUERY_DETAIL_URL, query_id, account=account)


def _day_after_months_before(as_of, months: int) -> dt.datetime:
    """``to_date(ts) > to_date(as_of) - months`` holds exactly when ``ts >=`` this."""
    return add_months(start_of_day(as_datetime(as_of)), -months) + dt.timedelta(days=1)


def most_expensive_queries(t: Tables, as_of: dt.datetime, months: int = 2, n: int = 200,
                           account: str = "account", with_start_time: bool = False) -> DataFrame:
    """Queries ranked by execution hours x warehouse nodes (relative cost).

    The warehouse-size table is eight fixed values, so it is a literal map
    lookup (no join); unknown sizes drop out as an inner join would drop them.
    Sizes match after upper-casing only, as in the original analysis, so a
    hyphenated spelling such as ``X-Small`` finds no node count and drops out.
    Ties are broken by query id so the top ``n`` is deterministic.
    """
    cut = add_months(as_datetime(as_of), -months)
    q = t.since(QH, cut, strict=True).withColumn("nodes", warehouse_nodes(F.col("warehouse_size")))
    q = q.filter(F.col("nodes").isNotNull())
    ms = F.col("execution_time")
    cols = [F.col("query_id")]
    if with_start_time:
        cols.append(F.col("start_time"))
    cols += [
        _query_url(account, F.col("query_id")).alias("qu"), "query_text", "user_name", "role_name",
        ms.alias("execution_time_milliseconds"),
        (ms / _MS_PER["seconds"]).alias("execution_time_seconds"),
        (ms / _MS_PER["minutes"]).alias("execution_time_minutes"),
        (ms / _MS_PER["hours"]).alias("execution_time_hours"),
        F.upper("warehouse_size").alias("warehouse_size"), "nodes",
        ((ms / _MS_PER["hours"]) * F.col("nodes")).alias("relative_performance_cost"),
    ]
    out = q.select(*cols)
    return top_k(out, [F.col("relative_performance_cost").desc_nulls_last(), F.col("query_id")], n)


def most_expensive_queries_recent(t: Tables, as_of: dt.datetime, months: int = 1, n: int = 50,
                                  account: str = "account") -> DataFrame:
    """The recent variant: one month, top 50, with the start time."""
    return most_expensive_queries(t, as_of, months=months, n=n, account=account, with_start_time=True)


def frequent_queries(t: Tables, as_of: dt.datetime, months: int = 1, min_count: int = 10, n: int = 100) -> DataFrame:
    """Query texts run at least ``min_count`` times, with total elapsed time.

    Query texts are the widest column of the log and mostly unique, so a
    plain ``groupBy(text)`` would shuffle nearly every text.  Instead the
    texts are first counted by a 64-bit hash (8 bytes per row through the
    shuffle, combined map-side).  A bitmap of the hashes that reach
    ``min_count``, of fixed size, drops the other rows where they are read,
    so the grouping by exact text shuffles candidates only.  Collisions can
    add candidates, never lose or merge texts, and the exact count is
    filtered again, so the result is exact.
    """
    q = t.since(QH, _day_after_months_before(as_of, months)).filter(F.col("total_elapsed_time") > 0)
    q = q.select("query_text", "total_elapsed_time", F.xxhash64("query_text").alias("_h"))
    candidates = q.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= min_count).select("_h")
    total = F.sum("total_elapsed_time")
    out = keep_hashes(q, candidates, "_h").groupBy("query_text").agg(
        F.count(F.lit(1)).alias("number_of_queries"),
        (total / _MS_PER["seconds"]).alias("execution_seconds"),
        (total / _MS_PER["minutes"]).alias("execution_minutes"),
        (total / _MS_PER["hours"]).alias("execution_hours"),
    ).filter(F.col("number_of_queries") >= min_count)
    return top_k(out, [F.col("number_of_queries").desc(), F.col("query_text")], n)


def _scan_candidates(t: Tables, as_of, months: int) -> DataFrame:
    return (t.since(QH, _day_after_months_before(as_of, months))
            .filter((F.col("total_elapsed_time") > 0) & F.col("error_code").isNull()
                    & F.col("partitions_scanned").isNotNull()))


def longest_queries(t: Tables, as_of: dt.datetime, months: int = 1, n: int = 50, account: str = "account") -> DataFrame:
    """The ``n`` longest queries of the last month, each labelled with its rank
    by partitions scanned among *all* qualifying queries.

    The label is the row number over partitions scanned (most first, then
    query id).  A survivor's is one more than the number of queries ahead of
    it, so the log is counted against the ``n`` survivors' keys
    (``rank_among``), never sorted or numbered.
    """
    q = _scan_candidates(t, as_of, months)
    survivors = top_k(q, [F.col("total_elapsed_time").desc(), F.col("query_id")], n)
    ranked = rank_among(survivors, q, [-F.col("partitions_scanned"), F.col("query_id")], n, name="query_id_int")
    return ranked.select(
        "query_id", _query_url(account, F.col("query_id")).alias("query_profile_url"), "query_id_int", "query_text",
        (F.col("total_elapsed_time") / 1000).alias("query_execution_time_seconds"),
        "partitions_scanned", "partitions_total", "total_elapsed_time",
    ).orderBy(F.col("total_elapsed_time").desc(), F.col("query_id")).drop("total_elapsed_time")


def most_scanned_queries(t: Tables, as_of: dt.datetime, months: int = 1, n: int = 50, account: str = "account",
                         region: str = "region") -> DataFrame:
    """The ``n`` queries that scanned the most partitions last month.

    Rank order equals output order here, so only the ``n`` survivors are
    numbered (a window over ``n`` rows).
    """
    q = _scan_candidates(t, as_of, months)
    order = [F.col("partitions_scanned").desc(), F.col("query_id")]
    top = top_k(q, order, n)
    url = url_for_query(QUERY_HISTORY_URL, F.col("query_id"), account=account, region=region)
    return top.select(
        "query_id", url.alias("query_profile_url"),
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("query_id_int"), "query_text",
        (F.col("total_elapsed_time") / 1000).alias("query_execution_time_seconds"),
        "partitions_scanned", "partitions_total",
        div0(F.col("partitions_scanned"), F.col("partitions_total")).alias("partitions_pct"),
    ).orderBy(*order)


def execution_time_buckets(t: Tables, as_of: dt.datetime, warehouse: str, weeks: int = 1) -> DataFrame:
    """Queries per execution-time bucket for one warehouse over the last week.

    Buckets follow the source's outer-join rules (see ``bucket_counts``):
    the whole log decides which buckets exist (one pass over its one value
    column), the week's rows of the warehouse decide the counts (pruned,
    pushed).
    """
    cut = start_of_day(as_datetime(as_of)) - dt.timedelta(weeks=weeks)
    passing = t.since(QH, cut).filter(
        (F.col("warehouse_name") == F.lit(warehouse)) & (F.col("total_elapsed_time") > 0))
    out = bucket_counts(t[QH], passing, value="total_elapsed_time", row_id="query_id")
    return out.orderBy("_lower").drop("_lower")


def _full_scans(t: Tables, as_of, months: int, fraction: float) -> DataFrame:
    cut = add_months(as_datetime(as_of), -months)
    scanned, total = F.col("partitions_scanned"), F.col("partitions_total")
    # The column-to-column test implies a pushable one (see ``spill_ratio``).
    implied = (scanned > 0) | (total < 0) if fraction >= 0 else F.lit(True)
    return t.since(QH, cut).filter(implied).filter(
        (scanned > total * F.lit(fraction)) & ~F.col("query_type").startswith("CREATE"))


def full_scan_users(t: Tables, as_of: dt.datetime, months: int = 1, fraction: float = 0.95) -> DataFrame:
    """Users by number of (near) full table scans last month."""
    return (_full_scans(t, as_of, months, fraction).groupBy("user_name")
            .agg(F.count(F.lit(1)).alias("count_of_queries")).orderBy(F.col("count_of_queries").desc(), "user_name"))


def full_scan_queries(t: Tables, as_of: dt.datetime, months: int = 1, fraction: float = 0.95, n: int = 50) -> DataFrame:
    """The worst ``n`` (near) full table scans of last month, all columns."""
    q = all_columns(_full_scans(t, as_of, months, fraction), QH)
    return top_k(q, [F.col("partitions_scanned").desc_nulls_last(), F.col("query_id")], n)


def heavy_scanners(t: Tables, as_of: dt.datetime, days: int = 45) -> DataFrame:
    """Mean fraction of partitions scanned per user and warehouse (0 when the table has none)."""
    cut = start_of_day(as_datetime(as_of)) - dt.timedelta(days=days - 1)
    frac = F.when(F.col("partitions_total") > 0, F.col("partitions_scanned") / F.col("partitions_total")).otherwise(0.0)
    return (t.since(QH, cut).groupBy("user_name", "warehouse_name")
            .agg(F.avg(frac).alias("avg_pct_scanned"))
            .orderBy(F.col("avg_pct_scanned").desc(), "user_name", "warehouse_name"))


def top_remote_spillers(t: Tables, as_of: dt.datetime, days: int = 45, n: int = 10) -> DataFrame:
    """The ``n`` queries that spilled the most bytes to remote storage."""
    cut = start_of_day(as_datetime(as_of)) - dt.timedelta(days=days - 1)
    q = t.since(QH, cut).filter(F.col("bytes_spilled_to_remote_storage") > 0).select(
        "query_id", F.substring("query_text", 1, 50).alias("partial_query_text"), "user_name", "warehouse_name",
        "warehouse_size", "bytes_spilled_to_remote_storage", "start_time", "end_time",
        (F.col("total_elapsed_time") / 1000).alias("total_elapsed_time"))
    return top_k(q, [F.col("bytes_spilled_to_remote_storage").desc(), F.col("query_id")], n)


def spill_ratio(t: Tables, factor: float = 5) -> DataFrame:
    """Queries that spilled more than ``factor`` x the bytes they scanned.

    A query that scanned 0 bytes but spilled passes the test; its ratio is
    NULL (no division by zero).
    """
    spilled, scanned = F.col("bytes_spilled_to_remote_storage"), F.col("bytes_scanned")
    # ``spilled > scanned * factor`` compares two columns, which no file
    # reader can use.  It implies ``spilled > 0 or scanned < 0`` (factor >= 0),
    # which the parquet reader can test against row-group statistics, so
    # row groups without any spill are skipped.  Both are applied: exact.
    implied = (spilled > 0) | (scanned < 0) if factor >= 0 else F.lit(True)
    q = t[QH].filter(implied).filter(spilled > scanned * F.lit(factor))
    return q.select(
        "query_id", "user_name", "warehouse_name", "warehouse_size", "bytes_scanned", "bytes_spilled_to_remote_storage",
        F.try_divide(F.col("bytes_spilled_to_remote_storage"), F.col("bytes_scanned")).alias("spilling_read_ratio"),
    ).orderBy(F.col("spilling_read_ratio").desc_nulls_last(), "query_id")


def queue_pressure(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Days and warehouses with queued load (candidates for more clusters)."""
    cut = next_midnight_or_same(add_months(as_datetime(as_of), -months))
    return (t.since("warehouse_load_history", cut, column="start_time")
            .groupBy(F.to_date("start_time").alias("date"), "warehouse_name")
            .agg(F.sum("avg_running").alias("sum_running"),
                 F.sum("avg_queued_load").alias("sum_queued"))
            .filter(F.col("sum_queued") > 0))


def cache_usage(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Bytes scanned and the share served from the warehouse cache, per warehouse."""
    cut = add_months(as_datetime(as_of), -months)
    out = t.since(QH, cut).filter(F.col("bytes_scanned") > 0).groupBy("warehouse_name").agg(
        F.count(F.lit(1)).alias("query_count"),
        # Bytes summed as decimal(38,0): a month of a busy warehouse can pass
        # the bigint range, which would fail under ANSI arithmetic.
        F.sum(F.col("bytes_scanned").cast("decimal(38,0)")).alias("bytes_scanned"),
        F.sum(F.col("bytes_scanned") * F.col("percentage_scanned_from_cache")).alias("bytes_scanned_from_cache"),
    )
    ratio = F.try_divide(F.col("bytes_scanned_from_cache").cast("double"), F.col("bytes_scanned").cast("double"))
    return out.withColumn("percent_scanned_from_cache", ratio).orderBy("percent_scanned_from_cache",
                                                                                "warehouse_name")


def role_segmentation(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Mean execution time and query count per warehouse and role, for
    warehouses used by more than one role.  The role count is a window over
    the aggregate (at most one row per role per warehouse)."""
    cut = next_midnight_or_same(add_months(as_datetime(as_of), -months))
    agg = t.since(QH, cut).groupBy("warehouse_name", "role_name").agg(
        F.avg("execution_time").alias("average_execution_time"),
        F.count("query_id").alias("count_of_queries"))
    out = agg.withColumn("roles_per_warehouse",
                         F.count("role_name").over(Window.partitionBy("warehouse_name")).cast("bigint"))
    return out.filter(F.col("roles_per_warehouse") > 1).orderBy(
        F.col("roles_per_warehouse").desc(), "warehouse_name", "role_name")
