"""Split intervals over the windows they overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import seconds_crossed
from .distinct import distinct_counts, distinct_state
from .intervals import interval_join


def overlap_split(intervals: DataFrame, windows: DataFrame, *, key: str, start: str = "start_time", end: str = "end_time",
                  window_start: str = "start_time", window_end: str = "end_time", duration_ms: str = "execution_time",
                  row_id: str = "query_id", width: int = 3600) -> DataFrame:
    """Per (key, window start): how much of the intervals falls in the window, and how many distinct ids.

    Windows are any rows with a key, a start and an end: of different
    lengths, with gaps, overlapping, repeated or empty.  An interval meets a
    window of its key in one of four ways, closed at both ends:

    * contained (starts and ends inside):  adds its own ``duration_ms``;
    * front (starts inside, ends after):   seconds from start to window end;
    * back (starts before, ends inside):   seconds from window start to end;
    * middle (spans the whole window):     seconds of the window;

    seconds counted as boundaries crossed.  Returns ``key``, ``window_start``,
    ``contained_ms``, ``partial_seconds`` and ``ids``: distinct non-null ids,
    counted for each of the four ways and added up, as four joins each with
    their own COUNT(DISTINCT) would.  Windows that meet nothing give no row.

    The pairs come from ``interval_join``; they are reduced to one row per
    (window, way, id) before the shuffle, which is by all three, so an hour
    that holds a third of the log is counted in many tasks.
    """
    a = intervals.select(F.col(key).alias("_key"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(duration_ms).alias("_ms"),
                         F.col(row_id).alias("_id"))
    b = windows.select(F.col(key).alias("_key"), F.col(window_start).alias("_ws"), F.col(window_end).alias("_we"))
    met = interval_join(a, b, on=["_key"], left_span=("_s", "_e"), right_span=("_ws", "_we"), width=width)
    s, e, ws, we = (F.col(c) for c in ("_s", "_e", "_ws", "_we"))
    starts, ends = s.between(ws, we), e.between(ws, we)
    way = (F.when(starts & ends, 0).when(starts & (e > we), 1).when(ends & (s < ws), 2).when((ws > s) & (we < e), 3))
    partial = F.when(way == 1, seconds_crossed(s, we)).when(way == 2, seconds_crossed(ws, e)).when(way == 3, seconds_crossed(ws, we))
    pairs = met.select("_key", "_ws", "_id", way.alias("_way"), F.when(way == 0, F.coalesce("_ms", F.lit(0))).alias("contained_ms"),
                       partial.alias("partial_seconds")).filter("_way IS NOT NULL")
    keys, sums = ["_key", "_ws", "_way"], ["contained_ms", "partial_seconds"]
    counted = distinct_counts(distinct_state(pairs, keys, "_id", sums), keys[:2], "_id", sums, name="ids")
    return counted.select(F.col("_key").alias(key), F.col("_ws").alias(window_start), *sums, "ids")
