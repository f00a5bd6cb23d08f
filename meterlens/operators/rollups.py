"""Time rollups shared by the cost-history reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_cost(df: DataFrame, keys: list[str], *, time_col: str = "start_time",
               value_col: str = "credits_used") -> DataFrame:
    """Sum ``value_col`` per calendar day of ``time_col`` and ``keys``.

    One hash aggregate; its partial (map-side) half collapses rows before the
    shuffle, so the exchange carries at most days x objects rows per task.
    """
    return df.groupBy(F.to_date(time_col).alias("date"), *[F.col(k) for k in keys]).agg(
        F.sum(value_col).alias(value_col)
    )


def weekly_mean_of_daily(df: DataFrame, *, time_col: str = "start_time", value_col: str = "credits_used",
                         out_col: str = "avg_daily_credits") -> DataFrame:
    """Mean over the days present in each week of the per-day sums.

    Days without rows do not count as zero.  Weeks start on Monday.  Two
    chained aggregates: the second runs on at most one row per day.
    """
    per_day = df.groupBy(F.to_date(time_col).alias("_day")).agg(F.sum(value_col).alias("_sum"))
    return per_day.groupBy(F.date_trunc("week", "_day").cast("date").alias("week")).agg(
        F.avg("_sum").cast("double").alias(out_col)
    )
