"""Report sections, as the reports are grouped for review, and a runner.

A section is a list of report keys; a report can appear in several.
"""

from __future__ import annotations

import datetime as dt
import inspect

from pyspark.sql import DataFrame

from ..sources.tables import MissingTable, Tables

SECTIONS: dict[str, list[str]] = {
    "demo": ["no_resource_monitor", "most_scanned_queries", "clustering_cost_daily", "cloud_services_ratio"],
    "setup": [
        "no_auto_resume", "no_auto_suspend", "long_suspension", "no_resource_monitor", "role_segmentation",
        "idle_users", "users_never_logged_in", "idle_roles", "idle_warehouses", "statement_timeouts",
        "stale_streams", "failed_tasks", "long_tasks",
    ],
    "usage": [
        "most_scanned_queries", "most_expensive_queries_recent", "credits_by_warehouse_all",
        "credits_by_warehouse_recent", "credits_by_hour_of_day", "query_volume_by_hour", "warehouse_over_7day_avg",
        "usage_forecast", "credits_by_client", "credits_by_user", "frequent_queries", "longest_queries",
        "execution_time_buckets", "cloud_services_ratio", "warehouse_utilization",
    ],
    "billing": [
        "billing_ledger", "most_expensive_queries", "cost_per_query", "clustering_cost_daily", "mview_cost_daily",
        "search_opt_cost_daily", "pipe_cost_daily", "replication_cost_daily",
    ],
    "performance": [
        "clustering_weekly_avg", "ingest_daily", "queue_pressure", "spill_ratio", "cache_usage", "heavy_scanners",
        "full_scan_users", "full_scan_queries", "top_remote_spillers", "mview_weekly_avg", "search_opt_weekly_avg",
        "pipe_weekly_avg", "replication_weekly_avg",
    ],
}


# --- Fixed values: the tier (1, 2, 3) each report carries in the catalogue;
# the recent variant of the most-expensive report has none.
TIERS: dict[str, int | None] = {
    **{k: 1 for k in [
        "credits_by_hour_of_day", "query_volume_by_hour", "billing_ledger", "credits_by_user",
        "credits_by_warehouse_all", "credits_by_warehouse_recent", "ingest_daily", "usage_forecast",
        "credits_by_client", "role_segmentation", "warehouse_over_7day_avg", "long_suspension", "no_auto_resume",
        "no_auto_suspend", "no_resource_monitor"]},
    **{k: 2 for k in [
        "cost_per_query", "failed_tasks", "idle_roles", "idle_users", "idle_warehouses", "long_tasks",
        "most_expensive_queries", "frequent_queries", "execution_time_buckets", "queue_pressure", "spill_ratio",
        "statement_timeouts", "stale_streams", "longest_queries", "most_scanned_queries", "users_never_logged_in",
        "warehouse_utilization", "cloud_services_ratio"]},
    **{k: 3 for k in [
        "clustering_cost_daily", "clustering_weekly_avg", "full_scan_users", "full_scan_queries", "heavy_scanners",
        "mview_cost_daily", "mview_weekly_avg", "replication_cost_daily", "replication_weekly_avg",
        "search_opt_cost_daily", "search_opt_weekly_avg", "pipe_cost_daily", "pipe_weekly_avg",
        "top_remote_spillers", "cache_usage"]},
    "most_expensive_queries_recent": None,
}
# --- end of fixed values


class MissingParameter(ValueError):
    """A report needs a parameter that was not given."""


class SectionReports(dict[str, DataFrame]):
    """The reports of a section by key; ``skipped`` names those that could
    not be built, with the reason."""

    def __init__(self) -> None:
        super().__init__()
        self.skipped: dict[str, str] = {}


def parameters(name: str) -> dict[str, inspect.Parameter]:
    """The parameters of a report besides its tables."""
    from . import REPORTS

    return {k: p for k, p in inspect.signature(REPORTS[name], eval_str=True).parameters.items() if k != "t"}


def run_report(t: Tables, name: str, as_of: dt.datetime | None = None, **params) -> DataFrame:
    """Run one report; ``as_of`` goes to reports that take it, any other
    parameter must be one of the report's."""
    from . import REPORTS

    accepted = parameters(name)
    unknown = sorted(set(params) - set(accepted))
    if unknown:
        raise ValueError(f"report {name!r} has no parameter {unknown}")
    if "as_of" in accepted:
        if as_of is None:
            raise MissingParameter(f"report {name!r} needs as_of")
        params["as_of"] = as_of
    missing = [k for k, p in accepted.items() if p.default is inspect.Parameter.empty and k not in params]
    if missing:
        raise MissingParameter(f"report {name!r} needs {missing}")
    return REPORTS[name](t, **params)


def run_section(t: Tables, section: str, as_of: dt.datetime | None = None, tier: int | None = None, *,
                one_scan: bool = False, **params) -> SectionReports:
    """All reports of a section (optionally of one tier) as lazy DataFrames.

    With ``one_scan`` the reports that group the query log or the metering
    (``sections.GROUPED``) come from one scan of their table per lookback
    class, which runs when this is called; the results are the same.

    A parameter goes to the reports that have it; one that none has is an
    error.  Reports that lack a parameter (e.g. the warehouse of
    ``execution_time_buckets``) or a table are listed in ``skipped`` of the
    result; every other error is raised.
    """
    names = [n for n in SECTIONS[section] if tier is None or TIERS.get(n) == tier]
    unknown = sorted(set(params) - {p for n in names for p in parameters(n)})
    if unknown:
        raise ValueError(f"no report of section {section!r} has a parameter {unknown}")
    out = SectionReports()
    shared: dict[str, DataFrame] = {}
    if one_scan and as_of is not None:
        from .sections import GROUPED, grouped_reports

        together = [n for n in names if n in GROUPED and GROUPED[n][0] in t]
        own = {n: {k: v for k, v in params.items() if k in parameters(n)} for n in together}
        shared = grouped_reports(t, together, as_of, own)
    for name in names:
        if name in shared:
            out[name] = shared[name]
            continue
        try:
            out[name] = run_report(t, name, as_of, **{k: v for k, v in params.items() if k in parameters(name)})
        except (MissingParameter, MissingTable) as err:
            out.skipped[name] = str(err)
    return out
