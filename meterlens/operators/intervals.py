"""Joins on overlapping intervals, by bins of growing width.

An interval belongs to the level whose bins are at least as wide as itself,
so it lies in one or two bins whatever its length; a sentinel end date costs
as much as a short query.  Two intervals that overlap share a bin at the
higher of their two levels, and the pair is reported once: at that level, in
the later of their first bins.  The join is an equi-join on (key, level, bin),
so Catalyst broadcasts a side it measures as small, and adaptive execution
splits a hot bin otherwise; there is no nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import epoch_second

#: How much wider the bins of a level are than those of the one below.
RATIO = 4
#: Seconds in the years 0001 to 9999, rounded up: bins this wide hold any interval.
_ALL_TIME = 320_000_000_000


def _widths(width: int) -> list[int]:
    """Bin widths of all levels, in seconds."""
    widths = [width]
    while widths[-1] < _ALL_TIME:
        widths.append(widths[-1] * RATIO)
    return widths


def _seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds of a time column; instants are counted as such, whatever the clocks of the session's zone do."""
    instant = isinstance(df.schema[name].dataType, T.TimestampType)
    return F.unix_seconds(F.col(name)) if instant else epoch_second(F.col(name)).cast("long")


def _bins(df: DataFrame, start: str, end: str, width: int, levels: Column | None) -> DataFrame:
    """``df`` with _level, _bin (exploded), _own (its level) and _first (its first bin at that level).

    ``levels``: those at which the other side's own intervals stand, or None to
    take every level from the own one up.
    """
    one, other = _seconds(df, start), _seconds(df, end)
    a, b = F.least(one, other), F.greatest(one, other)
    spans = _widths(width)
    top = len(spans) - 1
    own = F.lit(top)
    for k in reversed(range(top)):
        own = F.when(b - a <= spans[k], F.lit(k)).otherwise(own)
    ready = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_from", a).withColumn("_to", b).withColumn("_own", own)
    if levels is None:
        every = F.sequence(F.col("_own"), F.lit(top))
    else:
        ready = ready.withColumn("_levels", levels)
        every = F.array_distinct(F.transform("_levels", lambda k: F.greatest(k, F.col("_own"))))
    at_level = ready.withColumn("_level", F.explode(every)).drop("_levels")
    size = F.element_at(F.array(*[F.lit(s).cast("long") for s in spans]), F.col("_level") + 1)
    first, last = (F.floor(F.col(c) / size).cast("long") for c in ("_from", "_to"))
    return at_level.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last))).drop("_from", "_to")


def interval_join(left: DataFrame, right: DataFrame, *, on: Sequence[str] = (), left_span: tuple[str, str], right_span: tuple[str, str],
                  width: int = 3600) -> DataFrame:
    """Pairs of rows, equal in ``on``, whose closed intervals come within a second of each other.

    Both spans are timestamp columns; their hulls are compared at whole
    seconds, so callers filter the pairs with their exact condition.  An
    interval that ends before it starts stands for its hull; null times and
    null keys never match.  ``right`` should be the side with fewer rows (it
    is spread over all levels, ``left`` over those that ``right`` uses).  The
    columns of both sides must have different names, but for ``on``.
    ``width``: seconds of the narrowest bins, about a usual length.

    Bins at a pair's level are at most ``RATIO`` times as wide as the longer
    of the two, which bounds the candidates that meet without overlapping.
    """
    on = list(on)
    b = _bins(right.select("*", *[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)]).drop(*on),
              *right_span, width, None)
    b = b.withColumnsRenamed({c: f"{c}r" for c in ("_own", "_level", "_first", "_bin")})
    levels = (_bins(right.select(*right_span), *right_span, width, None)
              .agg(F.collect_set("_own")).scalar())  # one number a level at most
    a = _bins(left, *left_span, width, levels)
    same = (F.col("_level") == F.col("_levelr")) & (F.col("_bin") == F.col("_binr"))
    for i, c in enumerate(on):
        same = same & (F.col(c) == F.col(f"_on{i}"))
    once = (F.col("_level") == F.greatest("_own", "_ownr")) & (F.col("_bin") == F.greatest("_first", "_firstr"))
    spare = [f"{c}{s}" for c in ("_own", "_level", "_first", "_bin") for s in ("", "r")] + [f"_on{i}" for i in range(len(on))]
    return a.join(b, same & once).drop(*spare)


def points_in_intervals(points: DataFrame, intervals: DataFrame, *, point: str, span: tuple[str, str], on: Sequence[str] = (),
                        width: int = 86_400) -> DataFrame:
    """Every point with every interval that holds it, both ends included (``BETWEEN``).

    Points and intervals may be dates or timestamps.  Intervals may overlap,
    repeat, leave gaps or be empty (end before start: they hold nothing).
    """
    start, end = span
    stamped = points.withColumn("_at", F.col(point).cast("timestamp_ntz"))
    spans = (intervals.withColumn("_lo", F.col(start).cast("timestamp_ntz")).withColumn("_hi", F.col(end).cast("timestamp_ntz"))
             .filter("_lo <= _hi"))
    met = interval_join(stamped, spans, on=on, left_span=("_at", "_at"), right_span=("_lo", "_hi"), width=width)
    return met.filter("_at >= _lo AND _at <= _hi").drop("_at", "_lo", "_hi")
