"""Exact distinct counts as a state that can be stored and merged."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_state(df: DataFrame, keys: Sequence[str], member: str, sums: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, member) with the ``sums`` of its rows: the exact set of members of each group.

    Rows are combined where they are read and shuffled by (keys, member), so
    a hot group is spread over all tasks by its members, and a hot member
    arrives as one row per task.  Null members form one row, whose sums count
    and whose member does not.  The state may be stored and merged later.
    """
    return df.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in sums])


def merge_states(states: Sequence[DataFrame], keys: Sequence[str], member: str, sums: Sequence[str] = ()) -> DataFrame:
    """The state of all rows that went into ``states``."""
    return reduce(DataFrame.unionByName, states).groupBy(*keys, member).agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in sums])


def distinct_counts(state: DataFrame, keys: Sequence[str], member: str, sums: Sequence[str] = (), name: str = "members") -> DataFrame:
    """Per group: distinct non-null members (``name``), ``rows`` and ``sums``; groups are counted task by task first."""
    return state.groupBy(*keys).agg(F.count(member).alias(name), F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in sums])
