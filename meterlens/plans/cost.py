"""Serverless cost history: per day and object, and weekly means of days.

Families A and B: one helper each, parameterised by table, keys, lookback
and order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import add_months, as_datetime
from ..operators.rollups import daily_cost, weekly_mean_of_daily
from ..sources.tables import Tables

_OBJECT_KEYS = ["database_name", "schema_name", "table_name"]


def _daily(t: Tables, table: str, keys: list[str], as_of, months: int, newest_first: bool) -> DataFrame:
    cut = add_months(as_datetime(as_of), -months)
    out = daily_cost(t.since(table, cut), keys)
    # Ties are broken by the remaining keys: the output order is total, and a
    # range exchange can split even a day with very many objects.
    first = [F.col("date").desc()] if newest_first else [F.col("credits_used").desc(), F.col("date").desc()]
    return out.orderBy(*first, *[F.col(k) for k in keys])


def clustering_cost_daily(t: Tables, as_of: dt.datetime, months: int = 6) -> DataFrame:
    """Automatic-clustering credits per day, database, schema and table; newest day first."""
    return _daily(t, "automatic_clustering_history", _OBJECT_KEYS, as_of, months, newest_first=True)


def mview_cost_daily(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Materialized-view refresh credits per day and object; most credits first."""
    return _daily(t, "materialized_view_refresh_history", _OBJECT_KEYS, as_of, months, newest_first=False)


def search_opt_cost_daily(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Search-optimization credits per day and object; most credits first."""
    return _daily(t, "search_optimization_history", _OBJECT_KEYS, as_of, months, newest_first=False)


def pipe_cost_daily(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Pipe (continuous ingest) credits per day and pipe; most credits first."""
    return _daily(t, "pipe_usage_history", ["pipe_name"], as_of, months, newest_first=False)


def replication_cost_daily(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Replication credits per day and database; most credits first."""
    return _daily(t, "replication_usage_history", ["database_name"], as_of, months, newest_first=False)


def _weekly(t: Tables, table: str, as_of, years: int) -> DataFrame:
    cut = add_months(as_datetime(as_of), -12 * years)
    return weekly_mean_of_daily(t.since(table, cut)).orderBy("week")


def clustering_weekly_avg(t: Tables, as_of: dt.datetime, years: int = 1) -> DataFrame:
    """Mean daily clustering credits per week over the last year (days present only)."""
    return _weekly(t, "automatic_clustering_history", as_of, years)


def mview_weekly_avg(t: Tables, as_of: dt.datetime, years: int = 1) -> DataFrame:
    """Mean daily materialized-view credits per week over the last year."""
    return _weekly(t, "materialized_view_refresh_history", as_of, years)


def search_opt_weekly_avg(t: Tables, as_of: dt.datetime, years: int = 1) -> DataFrame:
    """Mean daily search-optimization credits per week over the last year."""
    return _weekly(t, "search_optimization_history", as_of, years)


def pipe_weekly_avg(t: Tables, as_of: dt.datetime, years: int = 1) -> DataFrame:
    """Mean daily pipe credits per week over the last year."""
    return _weekly(t, "pipe_usage_history", as_of, years)


def replication_weekly_avg(t: Tables, as_of: dt.datetime, years: int = 1) -> DataFrame:
    """Mean daily replication credits per week over the last year."""
    return _weekly(t, "replication_usage_history", as_of, years)
