"""Token ids as Parquet list columns that allow selective reads.

Documents are range-partitioned and sorted by id, so files and rows stand in
ascending id order.  Ids are dictionary-coded, or delta-coded with version 2
pages; row groups and pages have set sizes, and the writer adds page indexes.
Counts and places are columns of their own: reading them leaves the ids on disk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted
from .tokens import default_vocabulary, encoder


def writer_options(encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10,
                   page_rows: int = 2_000) -> dict[str, str]:
    """Parquet settings for token files: ``encoding`` is "dictionary" or "delta"."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    return {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes),
            "parquet.page.row.count.limit": str(page_rows), "parquet.writer.version": "v2",
            "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "compression": "zstd"}


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                 end_id: int = 0, **settings) -> None:
    """Write (id, part, part_start, n_tokens, tokens) of whole texts in ascending id order (null ids first).

    A null text counts as empty; each document ends with ``end_id``.  Rows of
    one id are ordered by a hash of their text.  ``part`` numbers the ranges,
    ``part_start`` counts the ids before the document in its range.
    """
    vocabulary = vocabulary or default_vocabulary()
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    out = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("part", T.IntegerType()),
                        T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("tokens", T.ArrayType(T.IntegerType(), False))])
    names, end = [f.name for f in out], end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, total = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            first, size, held, counts = 0, 0, [], []
            for i, text in enumerate(batch["text"]):
                held.append(ids_of(text.as_py() or "") + end)
                counts.append(len(held[-1]) // 4)
                size += counts[-1]
                if size > 1_000_000 or i + 1 == len(batch):
                    ends = np.cumsum(counts)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()),
                                                     pa.array(np.frombuffer(b"".join(held), "<i4"), pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [batch["id"].slice(first, len(counts)), pa.array(np.full(len(counts), part, "int32")),
                         pa.array(total + ends - counts, pa.int64()), pa.array(counts, pa.int64()), lists], names=names)
                    total += size
                    first, size, held, counts = i + 1, 0, [], []

    ranged = (source.withColumn("hash", F.xxhash64("text")).repartitionByRange("id", "hash")
              .sortWithinPartitions("id", "hash").select("id", "text"))
    ranged.mapInArrow(encode, out).write.options(**writer_options(**settings)).parquet(path)


def read_tokens(spark: SparkSession, path: str, id_type: T.DataType = T.LongType()) -> DataFrame:
    """(id, start, n_tokens, tokens): ``start`` counts the ids of all documents before.  Unused columns are not read."""
    schema = T.StructType([T.StructField("id", id_type), T.StructField("part", T.IntegerType()),
                           T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    files = spark.read.schema(schema).parquet(path)
    # One row per range of the writer: as many rows as files.
    totals = files.groupBy(F.col("part").alias("p")).agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    parts = totals.select("p", F.coalesce(before, F.lit(0)).alias("before"))
    return (files.join(F.broadcast(parts), F.col("part") == F.col("p"))
            .select("id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "tokens"))


def token_checksums(tokens: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    out = T.StructType([f for f in tokens.schema if f.name != "tokens"] + [T.StructField("ids_crc32", T.LongType())])

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["tokens"]
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch[f.name] for f in out[:-1]] + [pa.array(sums, pa.int64())],
                                             names=[f.name for f in out])

    return tokens.mapInArrow(crc, out)
