"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits that ``monotonically_increasing_id`` gives to the rows of a partition.
_ROW_BITS = 33


def shared_path(df: DataFrame, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share (a local session may lack it)."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = os.path.join(os.environ.get("TMPDIR", "/tmp"), "meterlens-checkpoint")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def global_row_number(df: DataFrame, order: Sequence[Column], *, name: str = "row_number", path: str | None = None) -> DataFrame:
    """``df`` with the number (from 1) of each row in ``order``, as ROW_NUMBER() OVER (ORDER BY ...) gives it.

    Rows are range-partitioned and sorted by ``order``, numbered inside their
    partition, and written once to ``path`` (a new shared folder unless
    given); the numbers of rows in the partitions before are added from a
    table with one row per partition.  What is numbered is the stored frame,
    so a lost executor or a second action cannot change a number.

    Rows with equal keys get consecutive numbers in no stated order; end
    ``order`` with a unique key for one answer.  Equal keys are kept apart by
    a hash of the whole row, so that a hot key is split over partitions;
    only rows equal in every column stay together.
    """
    clash = {name, "_at"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the way")
    tie = F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
    # Descending or null-last keys keep their order: Spark partitions ranges by the sort order given.
    spread = df.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    path = path or shared_path(df, "numbered")
    spread.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    part = F.shiftright("_at", _ROW_BITS)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the only window here runs over these.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = stored.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn(name, F.col("_before") + inside + 1).select(*df.columns, name)
