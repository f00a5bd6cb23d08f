"""Ordering operators: top-k, and the rank of a few rows among many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows in ``order``: planned as TakeOrderedAndProject
    (each task keeps its own best ``n``; only those reach the final merge)."""
    return df.orderBy(*order).limit(n)


def rank_among(few: DataFrame, many: DataFrame, key: Sequence[Column], n: int, *, name: str = "row_number") -> DataFrame:
    """``few`` (at most ``n`` rows, all of them rows of ``many``) with the row
    number each has in ``many`` ordered by ``key`` ascending.

    A row's number is one more than the rows ahead of it.  The keys of
    ``few`` form a sorted array (a scalar subquery of ``n`` entries); every
    row of ``many`` finds by binary search how many of them stand at or
    before it, and rows are counted by that position: n + 1 groups, combined
    map-side.  Summing the counts up to a row's place gives its number.  No
    sort, window or range exchange of ``many``.  Rows of ``few`` with equal
    keys get consecutive numbers.
    """
    packed = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)])
    keys = few.agg(F.sort_array(F.collect_list(packed))).scalar()
    located = many.select(packed.alias("_key")).withColumn("_keys", keys)
    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    place = F.aggregate(
        steps, F.struct(F.lit(0).alias("lo"), F.size("_keys").alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s)
        .when(F.get(F.col("_keys"), middle(s)) <= F.col("_key"), F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi"))),
        lambda s: s["lo"])
    counts = located.groupBy(place.alias("_place")).agg(F.count(F.lit(1)).alias("_n"))
    # Position -> rows, as one map of at most n + 1 entries.
    counted = counts.agg(F.map_from_entries(F.collect_list(F.struct("_place", "_n")))).scalar()
    numbered = few.withColumn("_key", packed).withColumn("_keys", keys).withColumn("_counts", counted)
    first = (F.array_position("_keys", F.col("_key")) - 1).cast("int")
    ahead = F.aggregate(F.sequence(F.lit(0), first), F.lit(0).cast("bigint"),
                        lambda total, i: total + F.coalesce(F.col("_counts")[i], F.lit(0)))
    twin = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return numbered.withColumn(name, (ahead + twin).cast("bigint")).drop("_key", "_keys", "_counts")
