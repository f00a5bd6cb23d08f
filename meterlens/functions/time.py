"""Time arithmetic around a fixed ``as_of`` instant.

The source reports call ``CURRENT_TIMESTAMP()``; ours take ``as_of`` so a
report is reproducible.  Cut-offs are computed once on the driver as plain
literals (a scalar, not data), which keeps every time filter a
``column >= literal`` comparison that Catalyst pushes into the parquet scan.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_datetime(value: dt.datetime | dt.date | str) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(str(value))


def add_months(t: dt.datetime, months: int) -> dt.datetime:
    """Calendar month arithmetic that clamps to the last day of the month."""
    index = t.year * 12 + (t.month - 1) + months
    year, month = divmod(index, 12)
    day = min(t.day, calendar.monthrange(year, month + 1)[1])
    return t.replace(year=year, month=month + 1, day=day)


def start_of_day(t: dt.datetime) -> dt.datetime:
    return dt.datetime(t.year, t.month, t.day)


def next_midnight_or_same(t: dt.datetime) -> dt.datetime:
    """Smallest midnight ``>= t``.

    ``to_date(ts) >= t`` (a date read as its midnight, compared with an
    instant) holds exactly when ``ts >= next_midnight_or_same(t)``; the
    right-hand form keeps the raw column and so stays a pushed filter.
    """
    day = start_of_day(t)
    return day if day == t else day + dt.timedelta(days=1)


def ts_lit(t: dt.datetime) -> Column:
    """A ``timestamp_ntz`` literal, independent of the session time zone."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def date_lit(d: dt.date) -> Column:
    return F.lit(d.isoformat()).cast("date")


def epoch_second(col: Column) -> Column:
    """Whole seconds since the epoch, floored (sub-second part dropped).

    Built from the value's own fields, so no session time zone (and none of
    its clock changes) is involved.
    """
    return (F.unix_date(F.to_date(col)).cast("bigint") * 86_400 + F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col))


def seconds_crossed(start: Column, end: Column) -> Column:
    """Second boundaries crossed from ``start`` to ``end``.

    This is how the source dialect counts ``DATEDIFF(second, a, b)``: it
    compares the truncated values, so 0.9 s to 1.1 s counts as 1.  Spark's
    ``timestampdiff`` counts whole elapsed units instead (0 here).
    """
    return (epoch_second(end) - epoch_second(start)).cast("bigint")


def days_crossed(start: Column, end: Column) -> Column:
    """Day boundaries crossed, i.e. ``DATEDIFF(day, a, b)`` on dates."""
    return F.datediff(F.to_date(end), F.to_date(start)).cast("bigint")


def hour_start(col: Column) -> Column:
    """``DATE_TRUNC('hour', ts)`` as ``timestamp_ntz``, built from the
    value's own fields so no session time zone is involved."""
    return F.make_timestamp_ntz(F.year(col), F.month(col), F.dayofmonth(col), F.hour(col), F.lit(0), F.lit(0))
