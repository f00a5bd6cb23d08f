"""Counting rows into value ranges with the source's outer-join rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EXECUTION_BUCKETS

#: Edges a table may have; they travel as one array to every task.
MOST_EDGES = 100_000

Edges = Sequence[tuple[str, float | None, float | None]] | DataFrame


def _edge_frame(spark, edges: Edges, kind: str) -> DataFrame:
    """(label, low, high) of all edges; a table of them is checked for its size."""
    if isinstance(edges, DataFrame):
        frame = edges.toDF("label", "low", "high")
        if frame.limit(MOST_EDGES + 1).count() > MOST_EDGES:
            raise ValueError(f"more than {MOST_EDGES} edges")
        return frame
    return spark.createDataFrame([tuple(e) for e in edges], f"label string, low {kind}, high {kind}")


def place_of(value: Column, bounds: Column) -> Column:
    """Number of ``bounds`` (a sorted array column) that are at or below ``value``, by binary search; null for null."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bounds) + F.lit(2))).cast("int"))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    found = F.aggregate(
        steps, F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s)
        .when(F.get(bounds, middle(s)) <= value, F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi"))),
        lambda s: s["lo"])
    return F.when(value.isNotNull(), found)


def _place(value: Column, edges: Edges, bounds: Column) -> Column:
    """``place_of``; a few literal edges are compared directly, inside generated code."""
    if isinstance(edges, DataFrame) or len(edges) > 32:
        return place_of(value, bounds)
    known = sorted({b for _, low, high in edges if low is not None and high is not None and low < high for b in (low, high)})
    steps = [F.when(value >= F.lit(b), F.lit(i + 1)) for i, b in enumerate(known)]
    return F.when(value.isNotNull(), F.greatest(F.lit(0), *steps) if steps else F.lit(0))


def bucket_counts(log: DataFrame, passing: DataFrame | Column, *, value: str, row_id: str, edges: Edges = EXECUTION_BUCKETS,
                  rest: tuple[str, float] = (EXECUTION_BUCKETS[-1][0], EXECUTION_BUCKETS[-1][1]),
                  label: str = "execution_time_bucket", count: str = "number_of_queries") -> DataFrame:
    """Rows per edge, as a full outer theta join would give: ``label``, ``count``, _lower.

    The source joins the whole ``log`` to the edges on
    ``low <= value < high`` (full outer), then keeps pairs whose log row
    passes a filter *or* whose id is missing, and counts non-NULL ids per
    (label, low), pairs without an edge under ``rest``.  ``edges``: (label,
    low, high) as a list or a table of at most ``MOST_EDGES`` rows, in any
    order, with gaps, overlaps, repeats and open ends.  Consequences kept
    here exactly:

    * an edge no log row falls in shows 0 (one with a NULL bound, or whose
      bounds are not ascending, never matches and so always shows);
    * an edge whose rows all fail the filter disappears;
    * rows that fall in no edge (NULL values too) count under ``rest``,
      which shows if any such row is kept, or an edge of that name does;
    * a row with a NULL id keeps its edge alive (counting 0).

    The bounds of all edges, sorted, cut the values into places; a row finds
    its place by binary search and only counts per place leave the tasks.
    With ``passing`` a condition this is one scan of ``log``.  With
    ``passing`` a frame (``log`` filtered, which the caller bounds by pruning
    and pushed filters) the counts come from it alone, and of ``log`` one
    pass reads the one column that decides which edges exist, and another,
    whose IS NULL test is pushed, the rows that lack an id.
    """
    kind = log.schema[value].dataType.simpleString()
    frame = _edge_frame(log.sparkSession, edges, kind)
    sound = frame.filter("low < high")
    bounds = sound.select(F.explode(F.array("low", "high")).alias("b")).agg(F.array_sort(F.collect_set("b"))).scalar()
    rid = F.col(row_id)

    def placed(df: DataFrame, *more: Column) -> DataFrame:
        held = df.select(F.col(value).alias("_v"), rid.alias("_id"), *more, bounds.alias("_bounds"))
        return held.select(_place(F.col("_v"), edges, F.col("_bounds")).alias("_p"), *[c for c in held.columns if c not in ("_v", "_bounds")])

    if isinstance(passing, DataFrame):
        seen = (placed(passing).groupBy("_p").agg(F.count("_id").alias("_n"), F.lit(True).alias("_kept"))
                .union(placed(log).groupBy("_p").agg(F.lit(0), F.lit(False)))
                .union(placed(log.filter(rid.isNull())).groupBy("_p").agg(F.lit(0), F.lit(True))))
        places = seen.groupBy("_p").agg(F.sum("_n").alias("_n"), F.max("_kept").alias("_kept"))
    else:
        places = placed(log, F.coalesce(passing, F.lit(False)).alias("_ok")).groupBy("_p").agg(F.count(F.when(F.col("_ok"), F.col("_id"))).alias("_n"),
                                          F.max(F.col("_ok") | F.col("_id").isNull()).alias("_kept"))
    # From here on there is at most one row per place, i.e. twice the edges and two; rows without a value have place null.
    known = frame.select("label", "low", F.when(F.col("low") < F.col("high"), F.struct("low", "high")).alias("_span"), F.lit(False).alias("_rest"))
    known = known.union(log.sparkSession.range(1).select(F.lit(rest[0]), F.lit(rest[1]).cast(kind), F.lit(None), F.lit(True)))
    turns = (sound.select(F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(1).alias("by")),
                                            F.struct(F.col("high").alias("at"), F.lit(-1).alias("by")))).alias("t"))
             .groupBy("t.at").agg(F.sum("t.by").alias("_by")))
    every = (log.sparkSession.range(1).select(bounds.alias("_bounds"))
             .select(F.posexplode(F.concat(F.array(F.lit(None).cast(kind)), "_bounds")).alias("_q", "_at")))
    so_far = Window.orderBy("_q")
    none, no = F.lit(0), F.lit(False)
    dense = (every.join(turns, F.col("_at") == F.col("at"), "left").join(places, F.col("_q") == F.col("_p"), "full")
             .select("_q", F.coalesce("_n", none).alias("_n"), F.coalesce("_kept", no).alias("_kept"),
                     F.struct("_q", F.sum(F.coalesce("_n", none)).over(so_far).alias("n"), F.count(F.when(F.col("_kept"), 1)).over(so_far).alias("kept"),
                              F.count("_kept").over(so_far).alias("seen")).alias("_sums"),
                     (F.col("_q").isNull() | (F.sum(F.coalesce("_by", none)).over(so_far) == 0)).alias("_loose")))
    loose = F.col("_loose") & F.col("_kept")
    # One row for all edges to look at: sums up to each place, and what lies in no edge.
    table = dense.agg(F.struct(F.array_sort(F.collect_list(F.when(F.col("_q").isNotNull(), F.col("_sums")))).alias("sums"),
                               F.sum(F.when(loose, F.col("_n"))).alias("n"))).scalar()
    looked = known.withColumn("_bounds", bounds).withColumn("_table", table)
    end, ahead = (F.get(F.col("_table.sums"), F.array_position("_bounds", F.col("_span")[side]).cast("int") - back)
                  for side, back in (("high", 1), ("low", 1)))
    n = F.when(F.col("_rest"), F.col("_table.n")).otherwise(F.coalesce(end["n"] - ahead["n"], none))
    shows = (F.when(F.col("_rest"), F.col("_table.n").isNotNull())
             .otherwise(F.col("_span").isNull() | (end["kept"] > ahead["kept"]) | (end["seen"] == ahead["seen"])))
    per_edge = looked.filter(shows).select("label", "low", n.alias("_n"))
    return (per_edge.groupBy(F.coalesce("label", F.lit(rest[0])).alias(label), F.coalesce("low", F.lit(rest[1]).cast(kind)).alias("_lower"))
            .agg(F.sum("_n").cast("bigint").alias(count)).select(label, count, "_lower"))
