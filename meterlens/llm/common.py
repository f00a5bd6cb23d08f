"""Helpers shared by the corpus operators: shared-folder storage and row packing."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where it is unset (local tests) a scratch folder is made; a cluster
    must name one, since executors cannot see a driver-local folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="corpus-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library from where the driver did; clusters install it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/corpus-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    Cuts lineage: what reads the result never recomputes ``df``, also after
    executors are lost.  ``discard`` deletes it once its last reader is
    stored, ``forget`` all that are left.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._stored_path = path
    return held


def discard(*frames: DataFrame) -> None:
    """Delete the folders of frames that ``stored`` returned; nothing that is still to run may read them."""
    for df in frames:
        _delete(df.sparkSession, df._stored_path)
        if df._stored_path in _written:
            _written.remove(df._stored_path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small iterative tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(spark: SparkSession) -> None:
    """Delete every folder that ``stored`` wrote; call it once results are saved."""
    while _written:
        _delete(spark, _written.pop())


def as_row(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns packed into one struct, so that added columns cannot clash with them."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(row: str, name: str) -> Column:
    return F.col(row).getField(name)


def from_row(df: DataFrame, name: str = "row") -> DataFrame:
    return df.select(f"{name}.*")


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as the empty text.

    The pattern matches only the runs that change, so single spaces cost no replacement.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")),
                            r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def text_bytes(docs: DataFrame, column: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, over the whole table."""
    got = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(quoted(column)))).alias("b")).first()
    return got["n"], got["b"] or 0
