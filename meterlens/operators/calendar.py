"""Calendar days as a derived dimension (no stored date table)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import date_lit


def calendar_days(spark: SparkSession, first: dt.date, last: dt.date, *, name: str = "d_date") -> DataFrame:
    """One row per day in ``[first, last]`` (inclusive).

    Generated from the bounds, so a range join ``day BETWEEN a AND b``
    becomes a scan of exactly the days wanted; its size is the term length.
    """
    return spark.range(1).select(
        F.explode(F.sequence(date_lit(first), date_lit(last), F.expr("INTERVAL 1 DAY"))).alias(name))
