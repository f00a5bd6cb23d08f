"""Spark-vs-DuckDB comparison, shaped like the driver's correctness check:
row count, column names and an order-insensitive hash of the values."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb
import pandas as pd

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    """Engine-neutral value: numbers as rounded floats, times as ISO strings."""
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (pd.Timestamp,)):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return None
        return repr(round(f, 6) + 0.0)
    if isinstance(v, (pd.Timestamp, dt.datetime, dt.date)):
        return pd.Timestamp(v).isoformat()
    return str(v)


def frame_rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm(x) for x in rec))
    return rows


def digest(rows: list[tuple]) -> str:
    h = hashlib.sha256()
    for r in sorted(rows, key=repr):
        h.update(repr(r).encode())
    return h.hexdigest()


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> dict:
    s = spark_df.toPandas()
    d = con.execute(sql).fetchdf()
    out = {"spark_rows": len(s), "oracle_rows": len(d), "columns_match": sorted(s.columns) == sorted(d.columns)}
    if not out["columns_match"]:
        out["spark_columns"], out["oracle_columns"] = sorted(s.columns), sorted(d.columns)
        out["match"] = False
        return out
    rs, rd = frame_rows(s), frame_rows(d)
    out["match"] = len(s) == len(d) and digest(rs) == digest(rd)
    if not out["match"]:
        a, b = set(rs), set(rd)
        out["only_spark"] = sorted(a - b, key=repr)[:3]
        out["only_oracle"] = sorted(b - a, key=repr)[:3]
    return out
