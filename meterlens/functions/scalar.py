"""Scalar expressions and fixed lookup values shared by the reports.

Everything here is a built-in Spark expression (JVM side, inside
whole-stage codegen); no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values that must equal the source reports -------------------------
# Warehouse size -> compute nodes (upper-case size names).
WAREHOUSE_NODES = [
    ("XSMALL", 1),
    ("SMALL", 2),
    ("MEDIUM", 4),
    ("LARGE", 8),
    ("XLARGE", 16),
    ("2XLARGE", 32),
    ("3XLARGE", 64),
    ("4XLARGE", 128),
]

# Execution-time buckets: label, lower bound ms (inclusive), upper bound ms
# (exclusive; None = open).
EXECUTION_BUCKETS = [
    ("Less than 1 second", 0, 1000),
    ("1-5 seconds", 1000, 5000),
    ("5-10 seconds", 5000, 10000),
    ("10-20 seconds", 10000, 20000),
    ("20-30 seconds", 20000, 30000),
    ("30-60 seconds", 30000, 60000),
    ("1-2 minutes", 60000, 120000),
    ("more than 2 minutes", 120000, None),
]

# Client application id prefix -> client family; anything else is reported
# as "NOT YET MAPPED: <id>".
CLIENT_PREFIXES = [
    ("Go ", "Go"),
    ("Snowflake UI ", "Snowflake UI"),
    ("SnowSQL ", "SnowSQL"),
    ("JDBC ", "JDBC"),
    ("PythonConnector ", "Python"),
    ("ODBC ", "ODBC"),
]
UNMAPPED_CLIENT = "NOT YET MAPPED: "

# Storage list price in dollars per TB-month.
STORAGE_DOLLARS_PER_TB_MONTH = 23

# Links to a query's profile; {query_id} is filled from the query log.
QUERY_DETAIL_URL = "https://{account}.snowflakecomputing.com/console#/monitoring/queries/detail?queryId={query_id}"
QUERY_HISTORY_URL = ("https://app.snowflake.com/{region}/{account}/compute/history/queries/{query_id}"
                     "/detail?autoRefreshInSeconds=0")

# Cost ledger: group label per metered source, then the measure types.
LEDGER_GROUPS = [
    ("warehouse_metering_history", "WH Compute"),
    ("pipe_usage_history", "Snowpipe"),
    ("automatic_clustering_history", "Auto Clustering"),
    ("materialized_view_refresh_history", "Materialized Views"),
    ("search_optimization_history", "Search Optimization"),
    ("replication_usage_history", "Replication"),
    ("storage_usage", "Storage"),
]
MEASURE_ACTUAL, MEASURE_PROJECTED, MEASURE_CONTRACT = "ACTUAL COMPUTE", "PROJECTED COMPUTE", "CONTRACT VALUES"

# Load method: without a pipe, with a pipe.
INGEST_BULK, INGEST_PIPE = "COPY", "SNOWPIPE"

# Task run states, and the statement-timeout parameter name.
TASK_FAILED, TASK_SUCCEEDED = "FAILED", "SUCCEEDED"
TIMEOUT_PARAMETER = "STATEMENT_TIMEOUT_IN_SECONDS"
# --- end of fixed values ------------------------------------------------------


def url_for_query(template: str, query_id: Column, **parts: str) -> Column:
    """Fill a profile-link template: text parts now, ``{query_id}`` per row."""
    before, after = template.split("{query_id}")
    return F.concat(F.lit(before.format(**parts)), query_id, F.lit(after.format(**parts)))


def div0(numerator: Column, denominator: Column) -> Column:
    """Division that yields 0 for a zero divisor (NULL stays NULL)."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def client_family(client_id: Column) -> Column:
    """Map a client application id to its family by prefix (first match wins)."""
    fallback = F.concat(F.lit(UNMAPPED_CLIENT), client_id)
    return reduce(
        lambda acc, pair: acc.when(client_id.startswith(pair[0]), F.lit(pair[1])),
        CLIENT_PREFIXES[1:],
        F.when(client_id.startswith(CLIENT_PREFIXES[0][0]), F.lit(CLIENT_PREFIXES[0][1])),
    ).otherwise(fallback)


def warehouse_nodes(size: Column) -> Column:
    """Node count for a warehouse size (case-insensitive); NULL if unknown.

    A literal map lookup: the inline size relation of the source becomes an
    expression, so no join (and no exchange) is planned for it.
    """
    pairs = [x for name, nodes in WAREHOUSE_NODES for x in (F.lit(name), F.lit(nodes).cast("bigint"))]
    return F.create_map(*pairs)[F.upper(size)]


def bucket_index(ms: Column) -> Column:
    """Index of the closed-open bucket holding ``ms``; NULL when none matches.

    The last bucket has no upper bound and so, like the source's theta join
    on ``ms < NULL``, is never matched here.
    """
    expr = None
    for i, (_, low, high) in enumerate(EXECUTION_BUCKETS):
        if high is None:
            continue
        cond = (ms >= low) & (ms < high)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def rounded(col: Column, places: int = 6) -> Column:
    """Ratios and means as doubles rounded half-up to ``places``.

    Written as ``floor(x * 10^p + 0.5) / 10^p`` so the result depends only on
    the IEEE value of ``x`` (plain arithmetic, identical in any engine),
    which makes results stable against summation-order noise.
    """
    scale = float(10 ** places)
    return F.floor(col.cast("double") * scale + 0.5).cast("double") / scale


def to_output(df: DataFrame, *, dates_as_timestamps: bool = False, as_double: tuple[str, ...] = (),
              places: Mapping[str, int] | None = None) -> DataFrame:
    """Present a report the way a data-frame client holds it.

    Decimal columns become doubles, and the columns in ``places`` are
    rounded to so many digits (reports themselves never round).  Optionally dates become midnight
    timestamps and the named (nullable integer) columns become doubles, as
    in a pandas frame, which has neither a date nor a nullable-integer type.
    """
    def present(f: T.StructField):
        col = F.col(f.name)
        if f.name in (places or {}):
            return rounded(col, places[f.name]).alias(f.name)
        if isinstance(f.dataType, T.DecimalType) or f.name in as_double:
            return col.cast("double").alias(f.name)
        if dates_as_timestamps and isinstance(f.dataType, T.DateType):
            return col.cast("timestamp_ntz").alias(f.name)
        return col

    return df.select(*[present(f) for f in df.schema.fields])
