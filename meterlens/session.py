"""Session construction and cluster-facing settings.

Reports never create sessions; they take whatever session owns the input
DataFrames.  This helper exists for tests, the bench and command-line use,
and it only *fills in* settings the cluster has not already fixed.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every report relies on.  AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is below the threshold, skew-join
# splitting, partition coalescing), which is the size check behind every join
# whose small side is not bounded by construction.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.ui.retainedExecutions": "10",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "meterlens") -> SparkSession:
    """A local session for tests and benchmarks (never used by the reports)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("METERLENS_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
