"""The cost ledger as stored daily sums, refreshed for changed days only.

The state has a row per day and service with the lines, credits and dollars
of the day: sums, so that states of different days or services add up to any
total, and the days of a term hold all that its forecast needs.  It is stored
in a folder per day; a refresh reads and rewrites the folders of the days it
is given and leaves the rest alone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import as_datetime, date_lit
from ..sources.tables import Tables
from .billing import AMOUNT, Contract, actual_costs, forecast_days

STATE_SCHEMA = f"service string, lines long, credits_used {AMOUNT}, dollars_used {AMOUNT}, day date"


def _runs(days: Iterable[dt.date]) -> list[tuple[dt.date, dt.date]]:
    """Days as runs (first, last) of neighbours."""
    runs: list[list[dt.date]] = []
    for day in sorted(set(days)):
        if runs and runs[-1][1] + dt.timedelta(days=1) == day:
            runs[-1][1] = day
        else:
            runs.append([day, day])
    return [(a, b) for a, b in runs]


def daily_costs(t: Tables, first: dt.date, last: dt.date, credit_price: float | str = "4.00") -> DataFrame:
    """The state of the days ``first`` to ``last``: each cost table is read for these days alone."""
    lo, hi = as_datetime(first), as_datetime(last) + dt.timedelta(days=1)
    lines = actual_costs(t, credit_price, lo, hi)
    return lines.groupBy(F.col("warehouse_group_name").alias("service"), F.to_date("start_time").alias("day")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("credits_used").cast(AMOUNT).alias("credits_used"),
        F.sum("dollars_used").cast(AMOUNT).alias("dollars_used")).select("service", "lines", "credits_used", "dollars_used", "day")


def refresh(t: Tables, path: str, days: Iterable[dt.date], credit_price: float | str = "4.00") -> None:
    """Recompute and replace the folders of ``days`` in the state at ``path``.

    Every given day is replaced, also one without lines any more (its folder
    then holds an empty marker row).  A refresh that is cut off replaces
    nothing and can be run again; days that are not given keep their files.
    """
    spark = t["warehouse_metering_history"].sparkSession
    parts = []
    for first, last in _runs(days):
        found = daily_costs(t, first, last, credit_price)
        every = spark.range(1).select(F.explode(F.sequence(date_lit(first), date_lit(last), F.expr("INTERVAL 1 DAY"))).alias("day"))
        marks = every.select(F.lit(None).cast("string").alias("service"), F.lit(0).cast("long").alias("lines"),
                             F.lit(None).cast(AMOUNT).alias("credits_used"), F.lit(None).cast(AMOUNT).alias("dollars_used"), "day")
        parts.append(found.unionByName(marks))
    if not parts:
        return
    state = parts[0]
    for part in parts[1:]:
        state = state.unionByName(part)
    (state.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def read_state(spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """The stored state, of the days from ``first`` to ``last`` if given (other folders are not listed)."""
    state = spark.read.schema(STATE_SCHEMA).parquet(path)
    if first is not None:
        state = state.filter(F.col("day") >= date_lit(first))
    if last is not None:
        state = state.filter(F.col("day") <= date_lit(last))
    return state.filter("service IS NOT NULL")


def ledger_totals(state: DataFrame) -> DataFrame:
    """Per service: days with lines, lines, credits and dollars."""
    return state.groupBy("service").agg(F.count(F.lit(1)).alias("days"), F.sum("lines").alias("lines"),
                                        F.sum("credits_used").cast(AMOUNT).alias("credits_used"),
                                        F.sum("dollars_used").cast(AMOUNT).alias("dollars_used"))


def forecast_from_state(spark: SparkSession, path: str, credit_price: float | str = "4.00", term_start: dt.date | str = "2020-01-01",
                        term_months: int = 12, term_amount: float | str = "100000.00") -> DataFrame:
    """``usage_forecast`` from the stored days of the term instead of the cost tables."""
    c = Contract(credit_price, term_start, term_months, term_amount, inclusive_end=False)
    state = read_state(spark, path, c.start.date(), c.end.date())
    actual = state.groupBy(F.col("day").alias("consumption_date")).agg(F.sum("dollars_used").cast(AMOUNT).alias("actual_dollars_used"))
    return forecast_days(spark, c, actual)
