"""Reports of a section that group one table, from one scan of it.

``GROUPED`` restates the grouped reports as ``Grouped`` results: the same
filters, keys and aggregates as their single functions, whose results they
equal.  Reports over all history share one scan of a table, those with a
lookback another one, bounded by the longest of them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import add_months, as_datetime, hour_start, next_midnight_or_same, start_of_day, ts_lit
from ..operators.onepass import Grouped, one_pass
from ..sources.tables import Tables

QH, WMH = "query_history", "warehouse_metering_history"
C = F.col


def _ratio(a: str, b: str) -> Column:
    return F.try_divide(C(a).cast("double"), C(b).cast("double"))


def _credits_all(as_of: dt.datetime, **_) -> tuple[dt.datetime | None, Grouped]:
    total = {"credits_used_compute_sum": (F.sum, C("credits_used_compute"))}
    return None, Grouped({"warehouse_name": C("warehouse_name")}, total,
                         finish=lambda df: df.orderBy(C("credits_used_compute_sum").desc(), "warehouse_name"))


def _credits_recent(as_of: dt.datetime, days: int = 7, **_) -> tuple[dt.datetime | None, Grouped]:
    return as_datetime(as_of) - dt.timedelta(days=days), _credits_all(as_of)[1]


def _credits_by_hour(as_of: dt.datetime, days: int = 7, **_) -> tuple[dt.datetime | None, Grouped]:
    return as_datetime(as_of) - dt.timedelta(days=days), Grouped(
        {"start_hour": F.hour("start_time").cast("bigint"), "warehouse_name": C("warehouse_name")},
        {"credits_used_compute_avg": (F.avg, C("credits_used_compute"))}, where=C("warehouse_id") > 0,
        finish=lambda df: df.withColumn("credits_used_compute_avg", C("credits_used_compute_avg").cast("double")).orderBy(
            "start_hour", "warehouse_name"))


def _cloud_services(as_of: dt.datetime, months: int = 1, **_) -> tuple[dt.datetime | None, Grouped]:
    return next_midnight_or_same(add_months(as_datetime(as_of), -months)), Grouped(
        {"warehouse_name": C("warehouse_name")},
        {"credits_used": (F.sum, C("credits_used")), "credits_used_cloud_services": (F.sum, C("credits_used_cloud_services"))},
        where=C("credits_used_cloud_services") > 0,
        finish=lambda df: df.withColumn("percent_cloud_services", _ratio("credits_used_cloud_services", "credits_used")).orderBy(
            C("percent_cloud_services").desc_nulls_last(), "warehouse_name"))


def _query_volume(as_of: dt.datetime, days: int = 7, **_) -> tuple[dt.datetime | None, Grouped]:
    return as_datetime(as_of) - dt.timedelta(days=days), Grouped(
        {"query_start_hour": hour_start(C("start_time")), "warehouse_name": C("warehouse_name")}, {"num_queries": (F.count, F.lit(1))},
        finish=lambda df: df.orderBy(C("query_start_hour").desc(), "warehouse_name"))


def _full_scan_users(as_of: dt.datetime, months: int = 1, fraction: float = 0.95, **_) -> tuple[dt.datetime | None, Grouped]:
    scans = (C("partitions_scanned") > C("partitions_total") * F.lit(fraction)) & ~C("query_type").startswith("CREATE")
    return add_months(as_datetime(as_of), -months), Grouped(
        {"user_name": C("user_name")}, {"count_of_queries": (F.count, F.lit(1))}, where=scans,
        finish=lambda df: df.orderBy(C("count_of_queries").desc(), "user_name"))


def _heavy_scanners(as_of: dt.datetime, days: int = 45, **_) -> tuple[dt.datetime | None, Grouped]:
    share = F.when(C("partitions_total") > 0, C("partitions_scanned") / C("partitions_total")).otherwise(0.0)
    return start_of_day(as_datetime(as_of)) - dt.timedelta(days=days - 1), Grouped(
        {"user_name": C("user_name"), "warehouse_name": C("warehouse_name")}, {"avg_pct_scanned": (F.avg, share)},
        finish=lambda df: df.orderBy(C("avg_pct_scanned").desc(), "user_name", "warehouse_name"))


def _cache_usage(as_of: dt.datetime, months: int = 1, **_) -> tuple[dt.datetime | None, Grouped]:
    return add_months(as_datetime(as_of), -months), Grouped(
        {"warehouse_name": C("warehouse_name")},
        {"query_count": (F.count, F.lit(1)), "bytes_scanned": (F.sum, C("bytes_scanned").cast("decimal(38,0)")),
         "bytes_scanned_from_cache": (F.sum, C("bytes_scanned") * C("percentage_scanned_from_cache"))},
        where=C("bytes_scanned") > 0,
        finish=lambda df: df.withColumn("percent_scanned_from_cache", _ratio("bytes_scanned_from_cache", "bytes_scanned")).orderBy(
            "percent_scanned_from_cache", "warehouse_name"))


def _role_segmentation(as_of: dt.datetime, months: int = 1, **_) -> tuple[dt.datetime | None, Grouped]:
    roles = F.count("role_name").over(Window.partitionBy("warehouse_name")).cast("bigint")
    return next_midnight_or_same(add_months(as_datetime(as_of), -months)), Grouped(
        {"warehouse_name": C("warehouse_name"), "role_name": C("role_name")},
        {"average_execution_time": (F.avg, C("execution_time")), "count_of_queries": (F.count, C("query_id"))},
        finish=lambda df: df.withColumn("roles_per_warehouse", roles).filter("roles_per_warehouse > 1").orderBy(
            C("roles_per_warehouse").desc(), "warehouse_name", "role_name"))


#: Report -> its table and, given ``as_of`` and the report's own parameters, its cut-off (None: all history) and grouping.
GROUPED: dict[str, tuple[str, Callable[..., tuple[dt.datetime | None, Grouped]]]] = {
    "credits_by_warehouse_all": (WMH, _credits_all), "credits_by_warehouse_recent": (WMH, _credits_recent),
    "credits_by_hour_of_day": (WMH, _credits_by_hour), "cloud_services_ratio": (WMH, _cloud_services),
    "query_volume_by_hour": (QH, _query_volume), "full_scan_users": (QH, _full_scan_users), "heavy_scanners": (QH, _heavy_scanners),
    "cache_usage": (QH, _cache_usage), "role_segmentation": (QH, _role_segmentation),
}


def grouped_reports(t: Tables, names: Iterable[str], as_of: dt.datetime, params: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """The named reports of ``GROUPED``; each table is read once for those over all history and once for those with a lookback.

    ``params``: further parameters by report.  The groups are computed and
    stored when this is called.
    """
    scans: dict[tuple[str, bool], dict[str, tuple[dt.datetime | None, Grouped]]] = {}
    for name in names:
        table, build = GROUPED[name]
        cut, grouped = build(as_of, **(params or {}).get(name, {}))
        scans.setdefault((table, cut is None), {})[name] = (cut, grouped)
    found = {}
    for (table, whole), parts in scans.items():
        df = t[table] if whole else t.since(table, min(cut for cut, _ in parts.values()))

        def since(cut: dt.datetime | None, where: Column | None) -> Column | None:
            inside = None if cut is None else C("start_time") >= ts_lit(cut)
            return where if inside is None else inside if where is None else inside & where

        found |= one_pass(df, {n: Grouped(g.keys, g.aggregates, since(cut, g.where), g.finish) for n, (cut, g) in parts.items()})
    return found
