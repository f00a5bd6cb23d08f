"""Data loading and task runs (family F)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import INGEST_BULK, INGEST_PIPE, TASK_FAILED, TASK_SUCCEEDED
from ..functions.time import as_datetime, seconds_crossed
from ..sources.tables import Tables, all_columns


def ingest_daily(t: Tables) -> DataFrame:
    """Loads per day, status, table and method (bulk copy vs continuous pipe):
    rows loaded and parsed, mean file size and total size in B/KB/MB/GB/TB."""
    ch = t["copy_history"]
    method = F.when(F.col("pipe_name").isNull(), INGEST_BULK).otherwise(INGEST_PIPE)
    total = F.sum("file_size")
    sizes = [(total / float(1024 ** i)).alias(f"total_file_size_{unit}")
             for i, unit in enumerate(["kb", "mb", "gb", "tb"], start=1)]
    out = ch.groupBy(
        F.to_date("last_load_time").alias("load_date"), "status",
        F.col("table_catalog_name").alias("database_name"), F.col("table_schema_name").alias("schema_name"),
        "table_name", method.alias("ingest_method"),
    ).agg(
        F.sum("row_count").cast("bigint").alias("row_count"),
        F.sum("row_parsed").cast("bigint").alias("rows_parsed"),
        F.avg("file_size").alias("avg_file_size_bytes"),
        total.cast("bigint").alias("total_file_size_bytes"),
        *sizes,
    )
    return out.orderBy("database_name", "schema_name", "table_name", "load_date", "status", "ingest_method")


def failed_tasks(t: Tables, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Task runs that failed in the last ``days``, all columns; newest first."""
    cut = as_datetime(as_of) - dt.timedelta(days=days)
    failed = t.since("task_history", cut).filter(F.col("state") == TASK_FAILED)
    return (all_columns(failed, "task_history")
            .orderBy(F.col("query_start_time").desc(), "task_id"))


def long_tasks(t: Tables, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Successful task runs of the last ``days`` with their duration, all columns; longest first."""
    cut = as_datetime(as_of) - dt.timedelta(days=days)
    runs = t.since("task_history", cut).filter(F.col("state") == TASK_SUCCEEDED)
    return all_columns(runs, "task_history").select(
        seconds_crossed(F.col("query_start_time"), F.col("completed_time")).alias("duration_seconds"), "*",
    ).orderBy(F.col("duration_seconds").desc(), "task_id")
