"""Shared operators the reports are built from.

Each is a composition of DataFrame operations chosen to hold up on a very
large query log: pre-aggregation before every shuffle, equi-joins instead of
range or theta joins, and no single-partition windows over data.
"""

from .allocate import allocate_by_share
from .buckets import bucket_counts, place_of
from .calendar import calendar_days
from .distinct import distinct_counts, distinct_state, merge_states
from .intervals import interval_join, points_in_intervals
from .numbering import global_row_number
from .overlap import overlap_split
from .prefilter import keep_hashes
from .ranking import rank_among, top_k
from .rollups import daily_cost, weekly_mean_of_daily

__all__ = [
    "allocate_by_share", "bucket_counts", "calendar_days", "daily_cost", "distinct_counts", "distinct_state", "global_row_number",
    "interval_join", "keep_hashes", "merge_states", "overlap_split", "place_of", "points_in_intervals", "rank_among", "top_k",
    "weekly_mean_of_daily",
]
