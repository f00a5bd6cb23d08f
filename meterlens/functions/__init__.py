"""Scalar helpers: time arithmetic around ``as_of`` and shared expressions."""

from .scalar import (
    CLIENT_PREFIXES,
    EXECUTION_BUCKETS,
    INGEST_BULK,
    INGEST_PIPE,
    LEDGER_GROUPS,
    MEASURE_ACTUAL,
    MEASURE_CONTRACT,
    MEASURE_PROJECTED,
    QUERY_DETAIL_URL,
    QUERY_HISTORY_URL,
    STORAGE_DOLLARS_PER_TB_MONTH,
    TASK_FAILED,
    TASK_SUCCEEDED,
    TIMEOUT_PARAMETER,
    UNMAPPED_CLIENT,
    WAREHOUSE_NODES,
    bucket_index,
    client_family,
    div0,
    rounded,
    to_output,
    url_for_query,
    warehouse_nodes,
)
from .time import (
    add_months,
    as_datetime,
    date_lit,
    days_crossed,
    epoch_second,
    hour_start,
    next_midnight_or_same,
    seconds_crossed,
    start_of_day,
    ts_lit,
)

__all__ = [
    "CLIENT_PREFIXES", "EXECUTION_BUCKETS", "INGEST_BULK", "INGEST_PIPE", "LEDGER_GROUPS", "MEASURE_ACTUAL",
    "MEASURE_CONTRACT", "MEASURE_PROJECTED", "QUERY_DETAIL_URL", "QUERY_HISTORY_URL", "TASK_FAILED",
    "TASK_SUCCEEDED", "TIMEOUT_PARAMETER", "url_for_query",
    "STORAGE_DOLLARS_PER_TB_MONTH", "UNMAPPED_CLIENT",
    "WAREHOUSE_NODES", "add_months", "as_datetime", "bucket_index", "client_family", "date_lit",
    "days_crossed", "div0", "epoch_second", "hour_start", "next_midnight_or_same", "rounded",
    "seconds_crossed", "start_of_day", "to_output", "ts_lit", "warehouse_nodes",
]
