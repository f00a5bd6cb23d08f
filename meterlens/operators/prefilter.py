"""Dropping rows before a shuffle by a bitmap of wanted hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap (8 MB whatever the data) and bits of one of its rows, as the bitmap functions cut them.
BITS, ROW_BITS = 1 << 26, 32768


def keep_hashes(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the hashes of ``wanted`` (same column).

    A Bloom filter with one hash: ``wanted`` sets bits of a bitmap of fixed
    size, which is broadcast (at most ``BITS`` / 8 bytes) and tested where
    ``df`` is read.  It keeps every wanted row and few others, so what
    follows shuffles little.  Null hashes are dropped.  The returned hash is
    computed from the bitmap as well, so that the optimizer does not move a
    later join on it below this one.
    """
    bit = F.pmod(F.col(column), F.lit(BITS))
    row = F.floor(bit / ROW_BITS).cast("int")
    bitmap = (wanted.select(row.alias("_row"), (bit % ROW_BITS).alias("_bit")).groupBy("_row")
              .agg(F.bitmap_construct_agg("_bit").alias("_bitmap")))
    # As 64-bit numbers, made once, since taking a byte out of the bitmap for every row costs more than the shuffle saved.
    eight = lambda k: F.conv(F.hex(F.substring("_bitmap", 8 * k + 1, F.lit(8))), 16, -10).cast("long")
    bitmap = bitmap.select("_row", F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1)), eight).alias("_numbers"))
    tested = df.withColumn("_bit", (bit % ROW_BITS).cast("int")).withColumn("_row", row).join(F.broadcast(bitmap), "_row")
    # Byte b of the bitmap holds bits 8 b to 8 b + 7, its lowest first; the first of eight bytes is a number's highest.
    held = F.getbit(F.get("_numbers", F.shiftright("_bit", 6)), 56 - F.col("_bit") % 64 + 2 * (F.col("_bit") % 8)) > 0
    return tested.filter(held).withColumn(column, F.when(held, F.col(column))).drop("_bit", "_row", "_numbers")
