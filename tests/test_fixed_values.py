"""Lookup values that must equal the analyses they stand for, stated a second time: the oracle takes them from the library."""

from meterlens.functions import scalar


def test_warehouse_nodes():
    assert scalar.WAREHOUSE_NODES == [("XSMALL", 1), ("SMALL", 2), ("MEDIUM", 4), ("LARGE", 8), ("XLARGE", 16),
                                      ("2XLARGE", 32), ("3XLARGE", 64), ("4XLARGE", 128)]


def test_execution_buckets():
    edges = [1, 5, 10, 20, 30, 60, 120]
    assert [low for _, low, _ in scalar.EXECUTION_BUCKETS] == [0] + [1000 * e for e in edges]
    assert [high for _, _, high in scalar.EXECUTION_BUCKETS] == [1000 * e for e in edges] + [None]
    assert [label for label, _, _ in scalar.EXECUTION_BUCKETS] == [
        "Less than 1 second", "1-5 seconds", "5-10 seconds", "10-20 seconds", "20-30 seconds", "30-60 seconds",
        "1-2 minutes", "more than 2 minutes"]


def test_labels():
    assert dict(scalar.CLIENT_PREFIXES)["PythonConnector "] == "Python" and len(scalar.CLIENT_PREFIXES) == 6
    assert all(prefix.endswith(" ") for prefix, _ in scalar.CLIENT_PREFIXES)
    assert scalar.UNMAPPED_CLIENT == "NOT YET MAPPED: "
    assert [label for _, label in scalar.LEDGER_GROUPS] == [
        "WH Compute", "Snowpipe", "Auto Clustering", "Materialized Views", "Search Optimization", "Replication", "Storage"]
    assert (scalar.MEASURE_ACTUAL, scalar.MEASURE_PROJECTED, scalar.MEASURE_CONTRACT) == (
        "ACTUAL COMPUTE", "PROJECTED COMPUTE", "CONTRACT VALUES")
    assert (scalar.INGEST_BULK, scalar.INGEST_PIPE, scalar.TASK_FAILED, scalar.TASK_SUCCEEDED) == (
        "COPY", "SNOWPIPE", "FAILED", "SUCCEEDED")
    assert scalar.TIMEOUT_PARAMETER == "STATEMENT_TIMEOUT_IN_SECONDS" and scalar.STORAGE_DOLLARS_PER_TB_MONTH == 23
