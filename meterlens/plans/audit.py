"""Identity and configuration audit (family G).

The inventory reports read snapshot tables (``warehouses``, ``streams``,
``parameters``) that a user fills from the platform's listing commands.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import TIMEOUT_PARAMETER
from ..functions.time import add_months, as_datetime, ts_lit
from ..sources.tables import Tables


def idle_users(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Users not deleted whose last login is more than ``months`` ago
    (users who never logged in are not listed here)."""
    cut = add_months(as_datetime(as_of), -months)
    u = t["users"]
    idle = (F.col("last_success_login") < ts_lit(cut)) & F.col("deleted_on").isNull()
    return u.filter(idle)


def users_never_logged_in(t: Tables) -> DataFrame:
    """Users without any successful login (deleted users included)."""
    return t["users"].filter(F.col("last_success_login").isNull())


def idle_roles(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Roles not deleted that ran no query in the last ``months``.

    The query log is reduced to its distinct role names (partial aggregate,
    at most one row per role per task) before an anti join.
    """
    cut = add_months(as_datetime(as_of), -months)
    used = t.since("query_history", cut, strict=True).select(F.col("role_name").alias("name")).distinct()
    roles = t["roles"].filter(F.col("deleted_on").isNull())
    return roles.join(used, roles["name"] == used["name"], "left_anti")


def idle_warehouses(t: Tables, as_of: dt.datetime, months: int = 1) -> DataFrame:
    """Inventory warehouses with no metering in the last ``months``.

    The output keeps the source's extra ``warehouse_name`` column, which is
    always NULL (it comes from the unmatched side of the anti join).
    """
    cut = add_months(as_datetime(as_of), -months)
    used = (t.since("warehouse_metering_history", cut, strict=True)
            .select(F.col("warehouse_name").alias("name")).distinct())
    warehouses = t["warehouses"]
    idle = warehouses.join(used, warehouses["name"] == used["name"], "left_anti")
    return idle.select("*", F.lit(None).cast("string").alias("warehouse_name"))


def _inventory(t: Tables, condition) -> DataFrame:
    return t["warehouses"].filter(condition).select(
        F.col("name").alias("warehouse_name"), F.col("size").alias("warehouse_size"))


def no_auto_resume(t: Tables) -> DataFrame:
    """Warehouses with auto-resume switched off."""
    return _inventory(t, F.col("auto_resume") == "false")


def no_auto_suspend(t: Tables) -> DataFrame:
    """Warehouses that never suspend (auto-suspend unset or 0)."""
    return _inventory(t, F.coalesce(F.col("auto_suspend"), F.lit(0)) == 0)


def long_suspension(t: Tables, seconds: int = 3600) -> DataFrame:
    """Warehouses that stay up at least ``seconds`` before suspending."""
    return _inventory(t, F.col("auto_suspend") >= seconds)


def no_resource_monitor(t: Tables) -> DataFrame:
    """Warehouses without a resource monitor (the listing shows the text 'null')."""
    return _inventory(t, F.col("resource_monitor") == "null")


def stale_streams(t: Tables) -> DataFrame:
    """Change streams whose offset fell out of the retention period."""
    return t["streams"].filter(F.col("stale") == F.lit(True))


def statement_timeouts(t: Tables, parameter: str = TIMEOUT_PARAMETER) -> DataFrame:
    """Per object, the statement timeout in force.

    The lowest non-zero of the values set for the object (0 means unset),
    whether as a warehouse or as a user; an object that sets none has the
    account's.  The account value is a scalar subquery (one row).
    """
    p = t["parameters"].filter(F.col("name") == parameter)
    account = p.filter((F.col("level") == "ACCOUNT") & (F.col("value") > 0)).agg(F.min("value")).scalar()
    own = p.groupBy("object").agg(F.min(F.when(F.col("value") > 0, F.col("value"))).alias("_own"))
    return own.select("object", F.coalesce("_own", account).cast("bigint").alias("effective_seconds")).orderBy("object")


def timeout_listing(t: Tables, level: str, name: str | None = None, parameter: str = TIMEOUT_PARAMETER) -> DataFrame:
    """The statement timeouts set at one ``level`` (ACCOUNT, WAREHOUSE or USER), or of its object ``name`` alone.

    The three listings that ``statement_timeouts`` merges, each as a result
    set of its own: name, level, object, value.
    """
    p = t["parameters"].filter((F.col("name") == parameter) & (F.col("level") == level))
    return (p if name is None else p.filter(F.col("object") == name)).select("name", "level", "object", "value").orderBy("object")
