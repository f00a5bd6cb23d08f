"""Inventory listings as a Spark data source.

A platform's listing commands (warehouses, streams, parameters) are exported
now and then, one file per listing and moment::

    <path>/warehouses/2024-01-31T06-00-00.csv
    <path>/warehouses/part-2024-01-31T06-00-00-1.csv     (several files of one moment)

``spark.read.format("inventory")`` reads such a folder: the columns of the
listing as declared in ``SCHEMAS``, and ``snapshot_time`` from the file name.
By default it returns the newest snapshot at or before ``as_of``; other files
are listed by name only and never opened.  With ``snapshots`` set to ``all``
every snapshot is read, and filters on ``snapshot_time`` prune files.  Each
file is a partition of the scan.
"""

from __future__ import annotations

import csv
import datetime as dt
import json
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

from .tables import SCHEMAS

LISTINGS = ("warehouses", "streams", "parameters")
_MOMENT = re.compile(r"(\d{4}-\d\d-\d\dT\d\d-\d\d-\d\d)[^/]*\.(csv|jsonl?)$")
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
          LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class File(InputPartition):
    def __init__(self, path: str, moment: dt.datetime):
        super().__init__(path)
        self.moment = moment


def _filesystem(path: str):
    """The file system of a local path or a URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _value(text, kind: T.DataType):
    """A listed value as its declared type; empty text and the word NULL of other types are null."""
    if text is None or isinstance(kind, T.StringType):
        return text if text is None or isinstance(text, str) else json.dumps(text)
    if isinstance(text, str) and text.strip().upper() in ("", "NULL"):
        return None
    if isinstance(kind, T.BooleanType):
        return text if isinstance(text, bool) else text.strip().lower() in ("true", "y", "yes", "1")
    return int(text)


class InventoryReader(DataSourceReader):
    def __init__(self, listing: str, path: str, as_of: dt.datetime | None, every: bool):
        self.listing, self.path, self.as_of, self.every = listing, path.rstrip("/"), as_of, every
        self.tests: list[tuple[type, dt.datetime]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of ``snapshot_time`` with a moment; Spark applies the rest."""
        for f in filters:
            value = getattr(f, "value", None)
            if type(f) in _TESTS and f.attribute == ("snapshot_time",) and isinstance(value, dt.datetime) and self.every:
                self.tests.append((type(f), value.replace(tzinfo=None)))
            else:
                yield f

    def partitions(self) -> list[File]:
        from pyarrow import fs

        system, folder = _filesystem(f"{self.path}/{self.listing}")
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else "file:" if self.path.startswith("file:") else ""
        found = []
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            match = _MOMENT.search(info.path)
            if match and info.type == fs.FileType.File:
                moment = dt.datetime.strptime(match.group(1), "%Y-%m-%dT%H-%M-%S")
                if self.as_of is None or moment <= self.as_of:
                    found.append(File(prefix + info.path, moment))
        if not self.every and found:
            newest = max(f.moment for f in found)
            found = [f for f in found if f.moment == newest]
        return sorted((f for f in found if all(_TESTS[test](f.moment, value) for test, value in self.tests)), key=lambda f: f.value)

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # what Spark passes when there is no file
            return
        fields = SCHEMAS[self.listing].fields
        system, path = _filesystem(partition.value)
        with system.open_input_stream(path) as stream:
            text = stream.read().decode("utf-8-sig")
        if path.endswith(".csv"):
            rows = csv.DictReader(text.splitlines(keepends=True))
        else:
            rows = json.loads(text) if path.endswith(".json") else map(json.loads, filter(str.strip, text.splitlines()))
        for row in rows:
            given = {k.strip().lower().replace(" ", "_"): v for k, v in row.items() if k is not None}
            missing = [f.name for f in fields if f.name not in given]
            if missing:
                raise ValueError(f"{partition.value} lacks {missing}")
            yield (*[_value(given[f.name], f.dataType) for f in fields], partition.moment)


class InventorySource(DataSource):
    """Options: path, listing, as_of (ISO moment, optional), snapshots ("newest" or "all")."""

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def _listing(self) -> str:
        listing = self.options.get("listing", "")
        if listing not in LISTINGS:
            raise ValueError(f"listing must be one of {LISTINGS}, not {listing!r}")
        return listing

    def schema(self) -> T.StructType:
        return T.StructType([*SCHEMAS[self._listing()].fields, T.StructField("snapshot_time", T.TimestampNTZType())])

    def reader(self, schema: T.StructType) -> InventoryReader:
        as_of, which = self.options.get("as_of"), self.options.get("snapshots", "newest")
        if which not in ("newest", "all"):
            raise ValueError(f"snapshots must be newest or all, not {which!r}")
        return InventoryReader(self._listing(), self.options["path"], dt.datetime.fromisoformat(as_of) if as_of else None, which == "all")


def read_inventory(spark: SparkSession, path: str, listing: str, as_of: dt.datetime | None = None, snapshots: str = "newest") -> DataFrame:
    """A listing with its ``snapshot_time``: the newest snapshot at or before ``as_of``, or ``all``.

    A folder without a fitting snapshot gives an empty table.  Files lie
    where driver and executors can read them (a shared folder or a URI that
    pyarrow knows), and the library must be importable on executors.
    """
    spark.dataSource.register(InventorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("inventory").option("path", path).option("listing", listing).option("snapshots", snapshots)
    return (reader if as_of is None else reader.option("as_of", as_of.isoformat())).load()


def inventory_tables(spark: SparkSession, path: str, as_of: dt.datetime | None = None) -> dict[str, DataFrame]:
    """The three listings, for ``Tables({...} | inventory_tables(...))``."""
    return {name: read_inventory(spark, path, name, as_of) for name in LISTINGS}
