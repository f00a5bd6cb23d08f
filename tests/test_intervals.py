"""Interval joins, overlap over any windows, distinct states, global numbers and edges, each against DuckDB or a plain window."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterlens.operators import (
    bucket_counts, distinct_counts, distinct_state, global_row_number, interval_join, merge_states, overlap_split, points_in_intervals,
)

T0 = dt.datetime(2024, 1, 10)
FAR, EARLY = dt.datetime(9999, 12, 31), dt.datetime(1, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _spans(rnd, n, sentinels=True):
    """Spans from microseconds to weeks, some empty, some that end before they start, some without end."""
    out = []
    for _ in range(n):
        a = T0 + dt.timedelta(seconds=rnd.randrange(0, 400_000), microseconds=rnd.choice([0, 0, 1, 999_999]))
        b = a + rnd.choice([0, 1e-6, 1, 60, 3599, 3600, 7200, 90_000, 1_000_000, -1, -5000]) * dt.timedelta(seconds=1)
        if sentinels and rnd.random() < 0.1:
            a, b = rnd.choice([(a, FAR), (EARLY, b), (EARLY, FAR), (FAR, a)])
        out.append((None if rnd.random() < 0.03 else a, None if rnd.random() < 0.03 else b))
    return out


@pytest.mark.parametrize("width", [1, 600, 3600, 10**7])
def test_interval_join_meets_each_pair_once(spark, width):
    rnd = random.Random(width)
    left = [(i, rnd.choice("ab"), *s) for i, s in enumerate(_spans(rnd, 120))]
    right = [(i, rnd.choice("ab") if i % 9 else None, *s) for i, s in enumerate(_spans(rnd, 80))]
    a = spark.createDataFrame(left, "i long, key string, s timestamp_ntz, e timestamp_ntz").repartition(3)
    b = spark.createDataFrame(right, "j long, key string, ws timestamp_ntz, we timestamp_ntz")
    met = interval_join(a, b, on=["key"], left_span=("s", "e"), right_span=("ws", "we"), width=width)
    assert met.columns == ["i", "key", "s", "e", "j", "ws", "we"]
    got = [(r.i, r.j) for r in met.filter("least(s, e) <= greatest(ws, we) AND greatest(s, e) >= least(ws, we)").collect()]
    want = {(i, j) for i, k, s, e in left for j, m, ws, we in right
            if k == m and None not in (s, e, ws, we) and min(s, e) <= max(ws, we) and max(s, e) >= min(ws, we)}
    assert len(got) == len(set(got)) and set(got) == want
    assert "NestedLoop" not in _plan(met) and "Cartesian" not in _plan(met)
    assert interval_join(a, b.limit(0), on=["key"], left_span=("s", "e"), right_span=("ws", "we")).count() == 0


def test_instants_across_a_clock_change(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 2024-11-03 05:30 and 06:10 UTC are 01:30 and 01:10 on the clock; 05:50 UTC lies between.
        at = lambda h, m: dt.datetime(2024, 11, 3, h, m, tzinfo=dt.timezone.utc)
        a = spark.createDataFrame([(1, at(5, 30), at(6, 10))], "i long, s timestamp, e timestamp")
        b = spark.createDataFrame([(1, at(5, 50), at(5, 51)), (2, at(7, 0), at(7, 1))], "j long, ws timestamp, we timestamp")
        met = interval_join(a, b, left_span=("s", "e"), right_span=("ws", "we"), width=60).filter("s <= we AND e >= ws")
        assert [(r.i, r.j) for r in met.collect()] == [(1, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_long_intervals_cost_a_few_rows(spark):
    a = spark.createDataFrame([(i, "a", T0, FAR) for i in range(50)], "i long, key string, s timestamp_ntz, e timestamp_ntz")
    b = spark.createDataFrame([(j, "a", T0 + j * dt.timedelta(hours=1), T0 + (j + 1) * dt.timedelta(hours=1)) for j in range(24)],
                              "j long, key string, ws timestamp_ntz, we timestamp_ntz")
    from meterlens.operators.intervals import _bins

    rows = _bins(a, "s", "e", 3600, F.array(F.lit(0)))
    assert rows.count() <= 2 * 50
    assert interval_join(a, b, on=["key"], left_span=("s", "e"), right_span=("ws", "we")).count() == 50 * 24


_FOUR = """
with met as (
  select w.key, w.start_time, q.query_id, case
      when s between start_time and end_time and e between start_time and end_time then 0
      when s between start_time and end_time and e > end_time then 1
      when e between start_time and end_time and s < start_time then 2
      when start_time > s and end_time < e then 3 end as way, ms, s, e, end_time
  from w join q on q.key = w.key)
select key, start_time, sum(contained), sum(partial), sum(ids) from (
  select key, start_time, way, sum(case when way = 0 then coalesce(ms, 0) end) as contained,
    sum(case way when 1 then date_diff('second', s, end_time) when 2 then date_diff('second', start_time, e)
        when 3 then date_diff('second', start_time, end_time) end) as partial, count(distinct query_id) as ids
  from met where way is not null group by 1, 2, 3) x group by 1, 2"""


@pytest.mark.parametrize("seed", range(3))
def test_overlap_over_any_windows_equals_four_joins(spark, seed):
    rnd = random.Random(seed)
    queries = [(rnd.choice([None, *"pqrstuv"]), rnd.choice("ab"), s, e, rnd.choice([None, 5, 1000])) for s, e in _spans(rnd, 250)]
    windows = [(rnd.choice("abc"), *s) for s in _spans(rnd, 60)]
    windows += windows[:10]  # repeated windows
    q = spark.createDataFrame(queries, "query_id string, key string, start_time timestamp_ntz, end_time timestamp_ntz, execution_time long")
    w = spark.createDataFrame(windows, "key string, start_time timestamp_ntz, end_time timestamp_ntz")
    got = overlap_split(q, w, key="key")
    assert "NestedLoop" not in _plan(got) and "Cartesian" not in _plan(got)
    con = duckdb.connect()
    con.execute("create table q (query_id varchar, key varchar, s timestamp, e timestamp, ms bigint)")
    con.execute("create table w (key varchar, start_time timestamp, end_time timestamp)")
    con.executemany("insert into q values (?, ?, ?, ?, ?)", queries)
    con.executemany("insert into w values (?, ?, ?)", windows)
    want = sorted(con.execute(_FOUR).fetchall(), key=repr)
    mine = [(r.key, r.start_time, r.contained_ms, r.partial_seconds, r.ids) for r in got.collect()]
    assert sorted(mine, key=repr) == want and len(want) > 20


def test_points_in_intervals_equals_between(spark):
    rnd = random.Random(5)
    day = dt.date(2020, 1, 1)
    terms = [(i, day + dt.timedelta(days=rnd.randrange(300)), rnd.choice([-3, 0, 1, 30, 365, 900])) for i in range(40)]
    terms = [(i, a, a + dt.timedelta(days=n)) for i, a, n in terms] + [(99, None, day), (98, day, None), (97, day, dt.date(9999, 12, 31))]
    days = [(day + dt.timedelta(days=i),) for i in range(-10, 700)]
    met = points_in_intervals(spark.createDataFrame(days, "d date"), spark.createDataFrame(terms, "term long, a date, b date"),
                              point="d", span=("a", "b"))
    got = sorted((r.term, r.d) for r in met.collect())
    assert got == sorted((i, d) for (d,) in days for i, a, b in terms if a and b and a <= d <= b)
    assert met.columns == ["d", "term", "a", "b"]


def test_distinct_counts_of_a_hot_hour(spark):
    rnd = random.Random(6)
    rows = [(0 if i % 3 == 0 else rnd.randrange(1, 50), None if rnd.random() < 0.1 else f"id{rnd.randrange(4000)}", i % 7) for i in range(30_000)]
    df = spark.createDataFrame(rows, "hour long, id string, ms long").repartition(8)
    state = distinct_state(df, ["hour"], "id", ["ms"])
    got = {r.hour: (r.members, r["rows"], r.ms) for r in distinct_counts(state, ["hour"], "id", ["ms"]).collect()}
    con = duckdb.connect()
    con.register("log", pd.DataFrame(rows, columns=["hour", "id", "ms"]))
    want = {h: (n, c, int(m)) for h, n, c, m in con.execute("select hour, count(distinct id), count(*), sum(ms) from log group by 1").fetchall()}
    assert got == want
    # No task holds the members of the hot hour: the state is spread by member.
    spread = state.select("hour", F.spark_partition_id().alias("p")).filter("hour = 0").groupBy("p").count().collect()
    assert "hashpartitioning(hour" in _plan(state) and "id" in _plan(state).split("hashpartitioning(hour")[1].split(")")[0]
    assert sum(r["count"] for r in spread) > 3000
    # States of two halves merge to that of the whole.
    halves = [distinct_state(df.filter(F.col("ms") < 3), ["hour"], "id", ["ms"]), distinct_state(df.filter(F.col("ms") >= 3), ["hour"], "id", ["ms"])]
    merged = merge_states(halves, ["hour"], "id", ["ms"])
    assert {r.hour: (r.members, r["rows"], r.ms) for r in distinct_counts(merged, ["hour"], "id", ["ms"]).collect()} == want


@pytest.fixture
def whole_partitions(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_global_row_number_equals_the_window(spark, tmp_path, whole_partitions):
    rnd = random.Random(8)
    rows = [(i, 7 if i % 3 == 0 else rnd.randrange(0, 300), rnd.choice([None, "x", "y"])) for i in range(9000)]
    df = spark.createDataFrame(rows, "id long, k long, t string").repartition(6)
    order = [F.col("k").desc(), F.col("t").asc_nulls_last(), F.col("id")]
    numbered = global_row_number(df, order, name="n", path=str(tmp_path / "n"))
    got = {r.id: r.n for r in numbered.collect()}
    want = {r.id: r.n for r in df.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long")).collect()}
    assert got == want and numbered.columns == ["id", "k", "t", "n"]
    # The hot key is split, the log meets no single-task window, and the stored frame is what every action reads.
    stored = spark.read.parquet(str(tmp_path / "n"))
    parts = stored.filter("k = 7").select(F.shiftright("_at", 33).alias("p")).distinct().count()
    assert parts > 1 and {r.id: r.n for r in numbered.collect()} == got
    plan = _plan(numbered).split("Initial Plan")[0]
    assert plan.count("Window") <= 1 and "rangepartitioning" not in plan
    assert global_row_number(df.limit(0), order).count() == 0
    same = spark.createDataFrame([(1,)] * 50, "v long")
    assert sorted(r.row_number for r in global_row_number(same, [F.col("v")]).collect()) == list(range(1, 51))


_THETA = """
select coalesce(label, 'rest') as label, coalesce(b.low, -99) as low, count(id) as n
from log full outer join edges b on v >= b.low and v < b.high
where id is null or ok group by 1, 2"""


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("one_scan", [True, False])
def test_bucket_counts_of_any_edges(spark, seed, one_scan):
    rnd = random.Random(seed)
    edges = [(f"e{i}", rnd.choice([None, rnd.randrange(40)]) if rnd.random() < 0.2 else rnd.randrange(40),
              None if rnd.random() < 0.15 else rnd.randrange(45)) for i in range(rnd.choice([0, 1, 6, 40]))]
    edges += edges[:2] + [("rest", -99, 3)] * (seed % 2)  # repeats, and an edge named as the rest is
    rows = [(None if rnd.random() < 0.1 else f"q{i}", None if rnd.random() < 0.1 else rnd.randrange(-5, 50), rnd.random() < 0.3)
            for i in range(rnd.choice([0, 3, 60]))]
    log = spark.createDataFrame(rows, "id string, v long, ok boolean")
    table = spark.createDataFrame(edges, "label string, low long, high long") if seed % 3 else edges
    got = bucket_counts(log, F.col("ok") if one_scan else log.filter("ok"), value="v", row_id="id", edges=table, rest=("rest", -99),
                        label="label", count="n")
    con = duckdb.connect()
    con.execute("create table log (id varchar, v bigint, ok boolean); create table edges (label varchar, low bigint, high bigint)")
    if rows:
        con.executemany("insert into log values (?, ?, ?)", rows)
    if edges:
        con.executemany("insert into edges values (?, ?, ?)", edges)
    assert sorted((r.label, r._lower, r.n) for r in got.collect()) == sorted(con.execute(_THETA).fetchall())


def test_bucket_counts_reads_the_log_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    log = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 97).alias("v"), (F.col("id") % 2 == 0).alias("ok"))
    log = log.mapInArrow(counted, "id string, v long, ok boolean")
    edges = spark.createDataFrame([("a", 0, 50), ("b", 20, 60), ("c", 80, 90)], "label string, low long, high long")
    got = bucket_counts(log, F.col("ok"), value="v", row_id="id", edges=edges, rest=("rest", -1))
    assert {r[0] for r in got.collect()} == {"a", "b", "c", "rest"}
    assert read.value == 1000


def test_too_many_edges_are_refused(spark, monkeypatch):
    from meterlens.operators import buckets

    monkeypatch.setattr(buckets, "MOST_EDGES", 3)
    edges = spark.createDataFrame([(str(i), i, i + 1) for i in range(4)], "label string, low long, high long")
    log = spark.createDataFrame([("a", 1)], "id string, v long")
    with pytest.raises(ValueError, match="more than 3 edges"):
        bucket_counts(log, F.lit(True), value="v", row_id="id", edges=edges)
