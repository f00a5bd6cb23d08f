"""Corpus pipeline over ``documents``: each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import new_folder
from meterlens.llm.contentsort import content_sort_dedup
from meterlens.llm.packing import pack_texts
from meterlens.llm.pseudonym import replace_personal
from meterlens.llm.registry import PSEUDONYM_KEY, table
from meterlens.llm.simhash import keep_one_of_each
from meterlens.llm.weaklabel import classify, fit


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go; columns unchanged."""
    return classify(docs, fit(docs)).filter("kept").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays; columns unchanged."""
    return content_sort_dedup(docs, kept_only=True).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays; columns unchanged."""
    return keep_one_of_each(docs, width=3, max_bits=3)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers and dates get pseudonyms; the other columns stay, n_chars follows the text."""
    return replace_personal(docs, PSEUDONYM_KEY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of at most 1,024 tokens, ids included (little-endian 32-bit)."""
    return pack_texts(docs, capacity=1024).withColumnRenamed("id", "doc_id").withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("personal_data", personal_data), ("packing", packing)]

#: SQL cannot express the classifier, the fingerprints or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
