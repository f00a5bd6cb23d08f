"""Proportional allocation of a per-slot cost over the users of the slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allocate_by_share(usage: DataFrame, cost: DataFrame, *, who: str, slot: Sequence[str], weight: str,
                      cost_col: str, out_col: str = "allocated") -> DataFrame:
    """Split each slot's cost over ``who`` in proportion to summed ``weight``.

    ``usage`` has ``who``, the ``slot`` columns and ``weight``; ``cost`` has
    the ``slot`` columns and ``cost_col``.  Returns ``who``, ``slot[0]`` and
    ``out_col`` = sum over slots of ``share * cost``.

    Plan: usage is summed per (who, slot) with a map-side partial aggregate;
    slot totals are a second aggregate of that (one row per slot).  Both the
    totals and the slot costs join the per-(who, slot) rows on the slot
    columns, i.e. equi-joins against one row per key, so a slot used by
    very many ``who`` never has to sit in one task: AQE splits a skewed
    key's partition (or broadcasts a side whose measured size is small).
    A final aggregate per (who, slot[0]).
    """
    slot = list(slot)
    per_who = usage.groupBy(who, *slot).agg(F.sum(weight).alias("_w"))
    totals = per_who.groupBy(*slot).agg(F.sum("_w").alias("_total"))
    share = per_who.join(totals, on=slot, how="inner").withColumn(
        "_share", F.try_divide(F.col("_w"), F.col("_total")))
    joined = share.join(cost.select(*slot, cost_col), on=slot, how="inner")
    return joined.groupBy(who, slot[0]).agg(F.sum(F.col("_share") * F.col(cost_col)).alias(out_col))
