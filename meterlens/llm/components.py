"""Connected components of an edge table by alternating large and small stars.

Each round replaces the edges by stars towards the smallest neighbour; the
number of rounds grows with the logarithm of the longest path.  Minima are
aggregates with map-side combine, and the joins that hand them back have two
plain shuffled sides, so that adaptive execution can split the hot key of a
large star.  Rounds are cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, m): m is the smallest b of each a, or a itself if smaller."""
    least = checkpointed(pairs.groupBy("a").agg(F.min("b").alias("m")))
    return pairs.join(least.select(F.col("a").alias("k"), F.least("a", "m").alias("m")), F.col("a") == F.col("k")).drop("k")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of ``edges``; component is the smallest node reachable.

    ``edges``: any two columns of one ordered type.  Loops, repeated edges and
    edges with a null end add nothing; an empty table gives an empty result.
    """
    left, right = edges.columns[:2]
    cur = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    cur = checkpointed(cur.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    mark = _mark(cur)
    if mark[0]:
        for _ in range(max_rounds):
            both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
            large = _to_minimum(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = checkpointed(large.distinct())
            known = _to_minimum(large)
            small = (known.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .union(known.select("a", F.col("m").alias("b"))))
            cur = checkpointed(small.filter("a <> b").distinct())
            before, mark = mark, _mark(cur)
            if mark == before:
                break
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("b").alias("a"), "b").distinct()
    return cur.union(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
