"""Edge cases of the shared operators, each checked against a brute-force
statement of the source semantics on a small hand-made frame."""

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.functions import (
    EXECUTION_BUCKETS, add_months, client_family, div0, next_midnight_or_same, rounded, seconds_crossed,
)
from meterlens.operators import allocate_by_share, bucket_counts, keep_hashes, overlap_split, rank_among, top_k
from meterlens.plans.billing import Contract

H = dt.timedelta(hours=1)
T0 = dt.datetime(2024, 1, 10, 0, 0, 0)


def _seconds(a: dt.datetime, b: dt.datetime) -> int:
    """Second boundaries crossed between a and b."""
    return int(b.replace(microsecond=0).timestamp()) - int(a.replace(microsecond=0).timestamp())


def _four_branch(queries, windows):
    """The source's four joins, literally: per (wh, window start) seconds and pairs."""
    out = {}
    for wh, ws in windows:
        we = ws + H
        secs_ms, secs, n = 0, 0, 0
        for qwh, s, e, ms in queries:
            if qwh != wh:
                continue
            if ws <= s <= we and ws <= e <= we:
                secs_ms += ms or 0
                n += 1
            elif ws <= s <= we and e > we:
                secs += _seconds(s, we)
                n += 1
            elif ws <= e <= we and s < ws:
                secs += _seconds(ws, e)
                n += 1
            elif ws > s and we < e:
                secs += _seconds(ws, we)
                n += 1
        if n:
            out[(wh, ws)] = (round(secs_ms / 1000 + secs, 6), n)
    return out


QUERY_SCHEMA = T.StructType([
    T.StructField("warehouse_name", T.StringType()), T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("end_time", T.TimestampNTZType()), T.StructField("execution_time", T.LongType()),
])


def _utilisation(spark, queries, windows):
    """overlap_split over hourly windows, as {(key, window start): (seconds, ids)}."""
    rows = [(f"q{i}", *q) for i, q in enumerate(queries)]
    log = spark.createDataFrame(rows, T.StructType([T.StructField("query_id", T.StringType()), *QUERY_SCHEMA]))
    hours = spark.createDataFrame([(wh, ws, ws + H) for wh, ws in windows], WINDOW_SCHEMA)
    got = overlap_split(log, hours, key="warehouse_name").collect()
    return {(r["warehouse_name"], r["start_time"]): (round((r["contained_ms"] or 0) / 1000 + (r["partial_seconds"] or 0), 6), r["ids"])
            for r in got}


WINDOW_SCHEMA = T.StructType([T.StructField("warehouse_name", T.StringType()), T.StructField("start_time", T.TimestampNTZType()),
                              T.StructField("end_time", T.TimestampNTZType())])


def test_hourly_overlap_edges(spark):
    us = dt.timedelta(microseconds=1)
    queries = [
        ("a", T0 + H, T0 + H + dt.timedelta(minutes=5), 300_000),          # starts exactly on the hour
        ("a", T0 + dt.timedelta(minutes=30), T0 + 2 * H, 5_400_000),       # ends exactly on the hour
        ("a", T0 + dt.timedelta(minutes=10), T0 + 3 * H + dt.timedelta(minutes=7), 1),  # spans 3+ hours
        ("a", T0 + 2 * H + dt.timedelta(minutes=1), T0 + 2 * H + dt.timedelta(minutes=1), 0),  # zero length
        ("a", T0 + H - us, T0 + H + us, 2),                                # crosses the edge by microseconds
        ("b", T0 + dt.timedelta(seconds=0.9), T0 + H + dt.timedelta(seconds=1.1), 10),
        ("b", T0, T0, None),                                               # NULL duration, exactly on the hour
        ("b", T0 + 3 * H + dt.timedelta(minutes=20), T0 + 3 * H + dt.timedelta(minutes=5), 7),  # ends before it starts
        ("b", T0 + 2 * H + dt.timedelta(minutes=5), T0 + H + dt.timedelta(minutes=50), 8),    # ends an hour early
    ]
    windows = [(wh, T0 + k * H) for wh in "ab" for k in range(-1, 5)]
    with_nulls = queries + [("a", None, T0 + H, 1), ("a", T0, None, 1), (None, T0, T0 + H, 1)]  # NULLs never match
    assert _utilisation(spark, with_nulls, windows) == _four_branch(queries, windows)


def test_hourly_overlap_random(spark):
    rnd = random.Random(7)
    queries = []
    for i in range(300):
        s = T0 + dt.timedelta(seconds=rnd.randrange(0, 20 * 3600), microseconds=rnd.choice([0, 0, 500_000, 999_999]))
        if rnd.random() < 0.2:
            s = s.replace(minute=0, second=0, microsecond=0)
        e = s + dt.timedelta(seconds=rnd.choice([0, 1, 59, 3600, 5000, 4 * 3600]), microseconds=rnd.randrange(0, 10**6))
        if rnd.random() < 0.1:
            e = e.replace(minute=0, second=0, microsecond=0) if e.replace(minute=0, second=0, microsecond=0) >= s else e
        queries.append((rnd.choice("xyz"), s, e, rnd.randrange(0, 10**7)))
    windows = [(wh, T0 + k * H) for wh in "xyz" for k in range(0, 26)]
    assert _utilisation(spark, queries, windows) == _four_branch(queries, windows)


LOG_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType()), T.StructField("warehouse_name", T.StringType()),
    T.StructField("total_elapsed_time", T.LongType()),
])

_BUCKET_SQL = """
with buckets as (select * from (values {values}) b(execution_time_bucket, lo, hi))
select coalesce(execution_time_bucket, 'more than 2 minutes') as execution_time_bucket,
  count(query_id) as number_of_queries
from log q full outer join buckets b on q.total_elapsed_time >= b.lo and q.total_elapsed_time < b.hi
where q.query_id is null or (warehouse_name = 'w' and total_elapsed_time > 0)
group by 1, coalesce(b.lo, 120000)
"""


@pytest.mark.parametrize("rows", [
    [],                                                                   # empty log: every bucket shows 0
    [("1", "w", 999), ("2", "w", 1000), ("3", "w", 120000), ("4", "w", None), ("5", "w", 0)],
    [("1", "other", 1500), ("2", "w", 1500), ("3", "other", 7000)],      # 5-10 s only filtered out: vanishes
    [("1", "other", 500), ("2", "other", 200000), ("3", "w", -5)],       # negative and too-large values
    [(None, "w", 2500), ("2", "other", 2600), ("3", "w", 50)],           # NULL id keeps its bucket alive
])
def test_bucket_counts_equals_full_outer_join(spark, rows):
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    passing = log.filter((F.col("warehouse_name") == "w") & (F.col("total_elapsed_time") > 0))
    got = bucket_counts(log, passing, value="total_elapsed_time", row_id="query_id")
    mine = sorted((r[0], r[1]) for r in got.collect())
    con = duckdb.connect()
    import pandas as pd
    con.register("log", pd.DataFrame(rows or [("x", "x", 0)][:0], columns=["query_id", "warehouse_name",
                                                                             "total_elapsed_time"]).astype(
        {"total_elapsed_time": "Int64"}))
    values = ", ".join(f"('{label}', {lo}, {hi if hi is not None else 'null'})" for label, lo, hi in EXECUTION_BUCKETS)
    want = sorted(tuple(r) for r in con.execute(_BUCKET_SQL.format(values=values)).fetchall())
    assert mine == want


def test_bucket_counts_plan(spark):
    log = spark.createDataFrame([("1", "w", 5)], LOG_SCHEMA)
    got = bucket_counts(log, log, value="total_elapsed_time", row_id="query_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _numbers(df, n):
    few = top_k(df, [F.col("v").desc(), F.col("id")], n)
    got = rank_among(few, df, [-F.col("k"), F.col("id")], n, name="rn")
    want = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("k").desc(), F.col("id"))).cast("long"))
    ids = [r["id"] for r in few.collect()]
    return ({r["id"]: r["rn"] for r in got.collect()},
            {r["id"]: r["rn"] for r in want.collect() if r["id"] in ids})


def test_rank_among_matches_window_with_hot_key(spark):
    rnd = random.Random(3)
    rows = [(str(i), 7 if i % 3 == 0 else rnd.randrange(0, 500), rnd.random()) for i in range(6000)]
    df = spark.createDataFrame(rows, "id string, k long, v double").repartition(5)
    got, want = _numbers(df, 50)
    assert got == want and len(got) == 50


def test_rank_among_few_rows_and_none(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "id string, k long, v double")
    got, want = _numbers(df, 50)
    assert got == want == {"a": 1, "b": 2}
    assert _numbers(df.filter("false"), 5) == ({}, {})


def test_rank_among_plan_and_laziness(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 9).alias("k"),
                                  F.rand(1).alias("v"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = rank_among(top_k(df, [F.col("v").desc(), F.col("id")], 5), df, [-F.col("k"), F.col("id")], 5)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before  # building runs nothing
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_keep_hashes_keeps_all_wanted(spark):
    df = spark.range(5000).select("id", F.xxhash64("id").alias("_h"))
    wanted = df.filter("id % 100 = 0").select("_h")
    kept = {r.id for r in keep_hashes(df, wanted, "_h").collect()}
    assert set(range(0, 5000, 100)) <= kept and len(kept) < 60
    assert keep_hashes(df, wanted.filter("false"), "_h").count() == 0


def test_keep_hashes_tests_every_bit(spark):
    places = [*range(300), *range(32700, 32800), (1 << 26) - 1, -1, -64]
    df = spark.createDataFrame([(p,) for p in places], "_h long")
    wanted = [p for p in places if p % 3 == 0]
    kept = keep_hashes(df, df.filter("_h % 3 = 0"), "_h")
    assert {r._h for r in kept.collect()} == set(wanted) | {-1}  # the same bit as (1 << 26) - 1


def test_top_k_ties_are_deterministic(spark):
    df = spark.createDataFrame([(str(i), i % 3) for i in range(30)], "id string, v long")
    got = [r["id"] for r in top_k(df, [F.col("v").desc(), F.col("id")], 5).collect()]
    assert got == ["11", "14", "17", "2", "20"]


def test_top_k_null_sort_keys_go_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 5), ("c", None), ("d", 7)], "id string, v long")
    got = [r["id"] for r in top_k(df, [F.col("v").desc_nulls_last(), F.col("id")], 3).collect()]
    assert got == ["d", "b", "a"]


def test_allocate_by_share_conserves_cost(spark):
    usage = spark.createDataFrame(
        [("u1", "w", 1, 10), ("u2", "w", 1, 30), ("u1", "w", 2, 5), ("u3", "v", 1, 7), ("u1", "w", 3, 1)],
        "who string, wh string, hour long, ms long")
    cost = spark.createDataFrame([("w", 1, Decimal("8.00")), ("w", 2, Decimal("2.00")), ("v", 1, Decimal("1.50")),
                                  ("v", 9, Decimal("4.00"))], "wh string, hour long, c decimal(18,2)")
    out = allocate_by_share(usage, cost, who="who", slot=["wh", "hour"], weight="ms", cost_col="c", out_col="x")
    got = {(r["who"], r["wh"]): round(r["x"], 9) for r in out.collect()}
    assert got == {("u1", "w"): 4.0, ("u2", "w"): 6.0, ("u3", "v"): 1.5}
    # Hours with usage keep their whole cost; hour 3 has usage but no cost row.
    assert sum(got.values()) == pytest.approx(8.0 + 2.0 + 1.5)


def test_scalar_helpers(spark):
    row = spark.range(1).select(
        div0(F.lit(5), F.lit(0)).alias("z"), div0(F.lit(5), F.lit(2)).alias("h"),
        div0(F.lit(None).cast("int"), F.lit(0)).alias("n"),
        seconds_crossed(F.lit("2024-01-01 00:00:00.9").cast("timestamp_ntz"),
                        F.lit("2024-01-01 00:00:01.1").cast("timestamp_ntz")).alias("s"),
        rounded(F.lit(0.1234565)).alias("r"), rounded(F.lit(2.5), 0).alias("r0"),
        client_family(F.lit("JDBC 3.1")).alias("c1"), client_family(F.lit("Custom 1")).alias("c2"),
        client_family(F.lit(None).cast("string")).alias("c3"),
    ).first()
    assert (row.z, row.h, row.n, row.s) == (0.0, 2.5, 0.0, 1)
    assert row.r0 == 3.0 and abs(row.r - 0.123457) < 1e-12
    assert (row.c1, row.c2, row.c3) == ("JDBC", "NOT YET MAPPED: Custom 1", None)


def test_time_helpers():
    assert add_months(dt.datetime(2000, 3, 31, 5), -1) == dt.datetime(2000, 2, 29, 5)
    assert add_months(dt.datetime(2001, 3, 31), -1) == dt.datetime(2001, 2, 28)
    assert add_months(dt.datetime(2024, 1, 15), -12) == dt.datetime(2023, 1, 15)
    assert next_midnight_or_same(dt.datetime(2024, 1, 15)) == dt.datetime(2024, 1, 15)
    assert next_midnight_or_same(dt.datetime(2024, 1, 15, 0, 0, 1)) == dt.datetime(2024, 1, 16)


def test_contract_days_over_leap_year():
    assert Contract(term_start="2000-01-01", inclusive_end=True).days == 366
    assert Contract(term_start="2000-01-01", inclusive_end=False).days == 365
    assert Contract(term_start="2001-01-01", inclusive_end=True).days == 365
