"""Telemetry table schemas and the ``Tables`` resolver.

Every report takes a ``Tables`` object and asks it for telemetry by name.
``Tables`` hides where the data lives (a parquet folder per table, catalog
tables, or DataFrames derived from other data) and adds partition predicates
for time-bounded scans, so a report that looks back one month reads one
month of files, not the whole history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import ts_lit

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
_TS, _D = T.TimestampNTZType(), T.DateType()
# Credits and loads carry nine decimals; sums keep them (decimal(28,9)).
_CREDITS = T.DecimalType(18, 9)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_SERVERLESS = (
    ("start_time", _TS), ("end_time", _TS), ("database_name", _S),
    ("schema_name", _S), ("table_name", _S), ("credits_used", _CREDITS),
)

# Columns are those the reports touch; names are lower case.
SCHEMAS: dict[str, T.StructType] = {
    "query_history": _schema(
        ("query_id", _S), ("query_text", _S), ("query_type", _S), ("user_name", _S),
        ("role_name", _S), ("warehouse_name", _S), ("warehouse_size", _S), ("session_id", _L),
        ("start_time", _TS), ("end_time", _TS), ("execution_time", _L), ("total_elapsed_time", _L),
        ("error_code", _S), ("partitions_scanned", _L), ("partitions_total", _L),
        ("bytes_scanned", _L), ("bytes_spilled_to_remote_storage", _L),
        ("percentage_scanned_from_cache", T.DoubleType()),
    ),
    "warehouse_metering_history": _schema(
        ("warehouse_id", _I), ("warehouse_name", _S), ("start_time", _TS), ("end_time", _TS),
        ("credits_used", _CREDITS), ("credits_used_compute", _CREDITS),
        ("credits_used_cloud_services", _CREDITS),
    ),
    "warehouse_load_history": _schema(
        ("warehouse_name", _S), ("start_time", _TS), ("avg_running", _CREDITS), ("avg_queued_load", _CREDITS),
    ),
    "automatic_clustering_history": _schema(*_SERVERLESS),
    "materialized_view_refresh_history": _schema(*_SERVERLESS),
    "search_optimization_history": _schema(*_SERVERLESS),
    "pipe_usage_history": _schema(("pipe_name", _S), ("start_time", _TS), ("end_time", _TS), ("credits_used", _CREDITS)),
    "replication_usage_history": _schema(
        ("database_name", _S), ("start_time", _TS), ("end_time", _TS), ("credits_used", _CREDITS),
    ),
    "storage_usage": _schema(("usage_date", _D), ("storage_bytes", _L), ("stage_bytes", _L), ("failsafe_bytes", _L)),
    "copy_history": _schema(
        ("last_load_time", _TS), ("status", _S), ("table_catalog_name", _S), ("table_schema_name", _S),
        ("table_name", _S), ("pipe_name", _S), ("row_count", _L), ("row_parsed", _L), ("file_size", _L),
    ),
    "sessions": _schema(("session_id", _L), ("client_application_id", _S)),
    "users": _schema(("name", _S), ("last_success_login", _TS), ("deleted_on", _TS)),
    "roles": _schema(("name", _S), ("deleted_on", _TS)),
    "task_history": _schema(("task_id", _L), ("state", _S), ("query_start_time", _TS), ("completed_time", _TS)),
    "warehouses": _schema(
        ("name", _S), ("size", _S), ("auto_suspend", _L), ("auto_resume", _S), ("resource_monitor", _S),
    ),
    "streams": _schema(("name", _S), ("stale", _B)),
    "parameters": _schema(("name", _S), ("level", _S), ("object", _S), ("value", _L)),
}

# Time column of each fact table and the date column it is partitioned by
# when stored with ``Tables.save``.  A bounded scan filters both, so the
# partition filter prunes folders and the exact filter trims the edges.
PARTITIONING: dict[str, tuple[str, str]] = {
    "query_history": ("start_time", "start_date"),
    "warehouse_metering_history": ("start_time", "start_date"),
    "warehouse_load_history": ("start_time", "start_date"),
    "automatic_clustering_history": ("start_time", "start_date"),
    "materialized_view_refresh_history": ("start_time", "start_date"),
    "search_optimization_history": ("start_time", "start_date"),
    "pipe_usage_history": ("start_time", "start_date"),
    "replication_usage_history": ("start_time", "start_date"),
    "copy_history": ("last_load_time", "load_date"),
    "task_history": ("query_start_time", "start_date"),
}

Source = DataFrame | Callable[[], DataFrame]


# A bounded reader returns the rows of a table whose time column may lie in
# [lo, hi) -- a superset is fine, the exact filter is applied afterwards.
BoundedReader = Callable[[dt.datetime | None, dt.datetime | None], DataFrame]


class MissingTable(KeyError):
    """A report asked for a telemetry table that the source does not have."""

    def __str__(self) -> str:
        return f"telemetry table {self.args[0]!r} is not available"


class Tables:
    """Named telemetry DataFrames, resolved lazily and memoised per name.

    A table that carries its date partition column (see ``PARTITIONING``)
    gets a predicate on it from ``since``/``between``.  A source may also
    register a *bounded reader* for a table: a way to read only a time range
    that is cheaper than filtering the whole table (used for tables derived
    by aggregation, whose time column is an expression the scan cannot see).
    """

    def __init__(self, sources: Mapping[str, Source], bounded: Mapping[str, BoundedReader] | None = None,
                 raw: Mapping[str, Callable[[], DataFrame]] | None = None):
        self._sources = dict(sources)
        self._raw = dict(raw or {})
        self._frames: dict[str, DataFrame] = {}
        self._bounded = dict(bounded or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            try:
                source = self._sources[name]
            except KeyError:
                raise MissingTable(name) from None
            try:
                self._frames[name] = source() if callable(source) else source
            except AnalysisException as err:
                if err.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
                    raise MissingTable(name) from err
                raise
        return self._frames[name]

    def __contains__(self, name: str) -> bool:
        return name in self._sources

    def replaced(self, frames: Mapping[str, Source]) -> Tables:
        """These tables with ``frames`` in place of, or beside, some of them."""
        kept = lambda d: {n: f for n, f in d.items() if n not in frames}
        return Tables({**self._sources, **frames}, bounded=kept(self._bounded), raw=kept(self._raw))

    def names(self) -> list[str]:
        return sorted(self._sources)

    def since(self, name: str, cut: dt.datetime, *, strict: bool = False, column: str | None = None) -> DataFrame:
        """Rows of ``name`` whose time column is ``>= cut`` (``> cut`` if strict).

        ``cut`` is a literal, so the comparison reaches the parquet reader as
        a pushed filter; on a date-partitioned table the matching partition
        predicate prunes whole folders first.
        """
        return self.between(name, cut, None, strict=strict, column=column)

    def between(self, name: str, lo: dt.datetime | None, hi: dt.datetime | None, *, strict: bool = False,
                column: str | None = None) -> DataFrame:
        """Rows of ``name`` with ``lo <= time < hi`` (``lo < time`` if strict);
        either bound may be None."""
        time_col, part_col = PARTITIONING.get(name, (None, None))
        column = column or time_col or ("usage_date" if name == "storage_usage" else None)
        if column is None:
            raise ValueError(f"{name!r} has no time column; pass column=")
        natural = column == (time_col or column)
        if natural and name in self._bounded:
            df = self._bounded[name](lo, hi)
        else:
            df = self[name]
        if natural and part_col and part_col in df.columns:
            if lo is not None:
                df = df.filter(F.col(part_col) >= F.lit(lo.date()))
            if hi is not None:
                df = df.filter(F.col(part_col) <= F.lit(hi.date()))
        col = F.col(column)
        if lo is not None:
            df = df.filter(col > ts_lit(lo) if strict else col >= ts_lit(lo))
        if hi is not None:
            df = df.filter(col < ts_lit(hi))
        return df

    def validate(self, names: list[str] | None = None) -> None:
        """Check that each table has the declared columns with castable types.

        Raises ``ValueError`` naming every missing column and every column
        whose values a cast could cut (a finer decimal scale, a wider integer).
        """
        problems = []
        for name in names or self.names():
            source = self._sources[name]  # as stored, before any cast
            raw = self._raw[name]() if name in self._raw else source() if callable(source) else source
            have = {f.name.lower(): f.dataType for f in raw.schema.fields}
            for f in SCHEMAS[name].fields:
                kind = have.get(f.name)
                if kind is None:
                    problems.append(f"{name}.{f.name}: missing")
                elif not _castable(kind, f.dataType):
                    problems.append(f"{name}.{f.name}: {kind.simpleString()} is not {f.dataType.simpleString()}")
        if problems:
            raise ValueError("telemetry schema problems: " + "; ".join(problems))

    def repeated_ids(self, name: str = "query_history", key: str = "query_id") -> DataFrame:
        """Ids that stand in more than one row, with their counts (none in sound telemetry)."""
        return (self[name].groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
                .filter(F.col(key).isNotNull() & (F.col("rows") > 1)))

    # -- constructors -------------------------------------------------
    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, names: list[str] | None = None) -> Tables:
        """One folder per table under ``root`` (as written by ``save``).

        Declared columns are cast to their types (a no-op when the files
        already hold them, so filters still reach the reader); all other
        columns, the date partition column among them, stay as they are.
        """
        names = names or list(SCHEMAS)
        return cls._conforming({n: (lambda n=n: _stored(spark, f"{root}/{n}", n)) for n in names})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, names: list[str] | None = None) -> Tables:
        """Catalog tables ``database.<name>``, all columns, declared ones cast to
        their types; a date partition column stays and prunes bounded scans."""
        names = names or list(SCHEMAS)
        return cls._conforming({n: (lambda n=n: spark.table(f"{database}.{n}")) for n in names})

    @classmethod
    def _conforming(cls, raw: Mapping[str, Callable[[], DataFrame]]) -> Tables:
        return cls({n: (lambda n=n: conform(raw[n](), n)) for n in raw}, raw=raw)

    def save(self, root: str, mode: str = "overwrite") -> None:
        """Write every table as parquet; fact tables partitioned by date.

        Fact tables are range-partitioned on (date, time): each task writes
        a run of consecutive days, and a day holding a large share of the
        rows is split over several tasks instead of landing in one.
        """
        for name in self.names():
            df = conform(self[name], name)
            if name in PARTITIONING:
                time_col, part_col = PARTITIONING[name]
                by_day = (df.withColumn(part_col, F.to_date(time_col))
                          .repartitionByRange(F.col(part_col), F.col(time_col))
                          .sortWithinPartitions(part_col, time_col))
                by_day.write.mode(mode).partitionBy(part_col).parquet(f"{root}/{name}")
            else:
                df.write.mode(mode).parquet(f"{root}/{name}")


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table in ``path``; a partitioned table that was saved without rows has no files, and no rows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the declared columns of ``name`` cast to their types and
    named in lower case; undeclared columns stay as they are, in place."""
    declared = {f.name: f.dataType for f in SCHEMAS[name].fields}
    have = {c.lower() for c in df.columns}
    missing = [c for c in declared if c not in have]
    if missing:
        raise ValueError(f"telemetry table {name!r} lacks {missing}")

    def column(c: str):
        col = F.col("`" + c.replace("`", "``") + "`")
        return col.cast(declared[c.lower()]).alias(c.lower()) if c.lower() in declared else col

    return df.select(*[column(c) for c in df.columns])


def all_columns(df: DataFrame, name: str) -> DataFrame:
    """``SELECT *`` of a table: every column but the date that only lays out its files."""
    layout = PARTITIONING[name][1] if name in PARTITIONING else None
    return df.drop(layout) if layout else df


_WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _castable(have: T.DataType, want: T.DataType) -> bool:
    """Whether every value of type ``have`` survives a cast to ``want``."""
    if have == want:
        return True
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    if isinstance(want, T.DecimalType):
        if isinstance(have, T.DecimalType):
            return have.scale <= want.scale and have.precision - have.scale <= want.precision - want.scale
        return type(have) in _WHOLE and _WHOLE[type(have)] <= want.precision - want.scale
    if isinstance(want, T.DoubleType):
        return isinstance(have, (T.FloatType, T.ByteType, T.ShortType, T.IntegerType)) or (
            isinstance(have, T.DecimalType) and have.precision <= 15)
    if type(want) in _WHOLE:
        if isinstance(have, T.DecimalType):
            return have.scale == 0 and have.precision < _WHOLE[type(want)]
        return type(have) in _WHOLE and _WHOLE[type(have)] <= _WHOLE[type(want)]
    if isinstance(want, times):
        return isinstance(have, times) or isinstance(have, T.StringType)
    if isinstance(want, T.StringType):
        return True
    if isinstance(want, T.BooleanType):
        return isinstance(have, (T.BooleanType, T.StringType))
    return False
