"""Property tests: the rewritten operators equal the original forms on random inputs."""

import duckdb
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterlens.functions import EXECUTION_BUCKETS
from meterlens.operators import bucket_counts, rank_among, top_k
from test_operators import _BUCKET_SQL, LOG_SCHEMA

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

log_rows = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(0, 50).map(str)), st.sampled_from(["w", "v"]),
              st.one_of(st.none(), st.integers(-10, 200_000), st.sampled_from([0, 999, 1000, 120000]))),
    max_size=40)


@SETTINGS
@given(rows=log_rows)
def test_bucket_counts_equals_full_outer_theta_join(spark, rows):
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    passing = log.filter((F.col("warehouse_name") == "w") & (F.col("total_elapsed_time") > 0))
    got = sorted((r[0], r[1]) for r in bucket_counts(
        log, passing, value="total_elapsed_time", row_id="query_id").collect())
    con = duckdb.connect()
    con.register("log", pd.DataFrame(rows, columns=["query_id", "warehouse_name", "total_elapsed_time"],
                                     dtype=object).astype({"total_elapsed_time": "Int64"}))
    values = ", ".join(f"('{label}', {lo}, {hi if hi is not None else 'null'})" for label, lo, hi in EXECUTION_BUCKETS)
    assert got == sorted(tuple(r) for r in con.execute(_BUCKET_SQL.format(values=values)).fetchall())


@SETTINGS
@given(keys=st.lists(st.integers(0, 5), min_size=0, max_size=120), n=st.integers(1, 9))
def test_rank_among_equals_window(spark, keys, n):
    df = spark.createDataFrame([(f"{i:04d}", k) for i, k in enumerate(keys)], "id string, k long")
    few = top_k(df, [F.xxhash64("id"), F.col("id")], n)
    got = {r["id"]: r["rn"] for r in rank_among(few, df, [-F.col("k"), F.col("id")], n, name="rn").collect()}
    want = {r["id"]: r["rn"] for r in df.withColumn(
        "rn", F.row_number().over(Window.orderBy(F.col("k").desc(), F.col("id")))).collect()}
    assert got == {i: want[i] for i in got} and len(got) == min(n, len(keys))


usage_rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.sampled_from(["w", "v"]),
                                st.integers(0, 5), st.integers(1, 10_000)), max_size=40)
cost_rows = st.lists(st.tuples(st.sampled_from(["w", "v", "x"]), st.integers(0, 6), st.integers(0, 99_999)),
                     max_size=14, unique_by=lambda r: (r[0], r[1]))


@SETTINGS
@given(usage=usage_rows, cost=cost_rows)
def test_allocate_by_share_equals_three_way_join(spark, usage, cost):
    from decimal import Decimal

    from meterlens.operators import allocate_by_share

    u = spark.createDataFrame(usage, "who string, wh string, hour long, ms long")
    c = spark.createDataFrame([(w, h, Decimal(v) / 100) for w, h, v in cost], "wh string, hour long, c decimal(18,2)")
    got = {(r["who"], r["wh"]): round(r["x"], 6) for r in allocate_by_share(
        u, c, who="who", slot=["wh", "hour"], weight="ms", cost_col="c", out_col="x").collect()}
    con = duckdb.connect()
    con.register("u", pd.DataFrame(usage, columns=["who", "wh", "hour", "ms"]))
    con.register("c", pd.DataFrame([(w, h, v / 100) for w, h, v in cost], columns=["wh", "hour", "c"]))
    want = {(w, wh): round(x, 6) for w, wh, x in con.execute("""
        with a as (select who, wh, hour, sum(ms) as t from u group by 1, 2, 3),
             b as (select wh, hour, sum(t) as t from a group by 1, 2)
        select a.who, c.wh, sum((a.t / b.t) * c.c) from a
        join b on a.hour = b.hour and a.wh = b.wh join c on c.wh = a.wh and c.hour = a.hour
        group by 1, 2""").fetchall()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
