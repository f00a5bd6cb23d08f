"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over (first characters of the
normalised text, SHA-256), sorted externally inside each partition so that
equal texts lie side by side, and compared with their neighbours in full: the
window groups rows by the whole normalised text, not by its digest.  The
splitters hold a bounded start of the text, never a whole one.

A text with more rows than an average partition is hot.  Its rows are dealt
to several ranges by a hash of their id, each range is compared on its own,
and the first rows of those ranges are compared in full once more.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import field, normalised, quoted, stored

#: Characters of the normalised text in the range key; equal starts go on by digest.
START = 24


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                       kept_only: bool = False) -> DataFrame:
    """One row per input row: row (struct of the ``carry`` columns, all by default), keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each white-space run is replaced by
    one space; null counts as empty, so null and empty texts form one group.
    keep_id is the smallest id of the group (nulls last, null if all are).
    Exactly one row of each group has ``kept``: that with the smallest id, and
    among repeated ids any one; ``kept_only`` returns these alone.  An empty
    table gives an empty result.  Extra columns pass through inside ``row``
    under any name.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = max(2, math.ceil(docs.count() / ranges))

    others = [F.col(quoted(c)).alias(c) for c in carry if c != text_col]
    filler = "_" * (1 + max(map(len, docs.columns)))  # a struct needs a field; this name is longer than any of theirs
    rows = docs.select(F.struct(F.lit(0).alias(filler), *others).alias("row"), F.col(quoted(id_col)).alias("id"),
                       F.col(quoted(text_col)).alias("text"))
    norm = normalised(F.col("text"))
    keyed = rows.select("*", F.xxhash64(norm).alias("h"), F.substring(norm, 1, START).alias("start"),
                        F.sha2(norm, 256).alias("digest"))
    # More rows than an average range: at most ``ranges`` such texts exist, so their hashes are a bounded broadcast.
    hot = (rows.select(F.xxhash64(norm).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") > share).select("h", F.ceil(F.col("n") / share).alias("salts")))
    dealt = (keyed.join(F.broadcast(hot), "h", "left")
             .select("row", "id", "text", "start", "digest", F.col("salts").isNotNull().alias("hot"),
                     F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)).alias("salt"))
             .repartitionByRange("start", "digest", "salt"))

    same = Window.partitionBy("start", "digest", "salt", "norm")
    by_id = same.orderBy(F.col("id").asc_nulls_last())
    texts = Window.partitionBy("start", "digest", "salt").orderBy("norm")
    first = F.col("hot") & (F.col("place") == 1)
    found = (dealt.withColumn("norm", norm)
             .select("*", F.row_number().over(by_id).alias("place"), F.first("id").over(by_id).alias("first_id"),
                     F.count(F.lit(1)).over(same).alias("size"), F.dense_rank().over(texts).alias("nth"))
             .drop("start", "id").withColumn("norm", F.when(first, F.col("norm"))))
    if kept_only:
        found = found.filter("place = 1")
    found = stored(found if text_col in carry else found.drop("text"), "content-sort")

    # The parts of hot texts, at most twice ``ranges`` rows: full comparison of their first rows.
    parts = (found.filter(first).groupBy("digest", "norm")
             .agg(F.min("first_id").alias("all_first"), F.sum("size").alias("all_size"),
                  F.collect_list(F.struct("salt", "nth")).alias("parts"))
             .select("digest", "all_first", "all_size", F.explode("parts").alias("part"))
             .select(F.col("digest").alias("d"), F.col("part.salt").alias("s"), F.col("part.nth").alias("k"),
                     "all_first", "all_size"))
    joined = found.drop("norm").join(
        F.broadcast(parts), F.col("hot") & (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s"))
        & (F.col("nth") == F.col("k")), "left")
    keep_id = F.when(F.col("hot"), F.col("all_first")).otherwise(F.col("first_id"))
    kept = (F.col("place") == 1) & F.col("first_id").eqNullSafe(keep_id)
    if kept_only:
        joined = joined.filter(kept)
    row = F.struct(*[(F.col("text") if c == text_col else field("row", c)).alias(c) for c in carry])
    return joined.select(
        row.alias("row"), keep_id.alias("keep_id"),
        F.when(F.col("hot"), F.col("all_size")).otherwise(F.col("size")).alias("group_size"),
        kept.alias("kept"), F.col("digest").alias("text_sha256"))
