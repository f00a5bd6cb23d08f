"""Every registered report against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as entry
from compare import compare
from conftest import SF01, SF001
from meterlens import REPORTS

NAMES = sorted(REPORTS)


def test_every_report_has_an_oracle():
    assert set(NAMES) <= set(entry.oracle_sql()) and set(NAMES) <= set(entry.queries())
    assert len(NAMES) == 49


@pytest.mark.parametrize("name", NAMES)
def test_report_matches_oracle(spark, duck01, name):
    result = compare(entry.queries()[name](spark, SF01), duck01, entry.oracle_sql()[name])
    assert result["columns_match"], result
    assert result["spark_rows"] == result["oracle_rows"], result
    assert result["match"], result


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_name", "warehouse_name", "approximate_credits_used"]
    assert df.count() > 0


def test_reports_are_deterministic(spark):
    q = entry.queries()
    for name in ["longest_queries", "most_expensive_queries", "frequent_queries"]:
        a = sorted(map(tuple, q[name](spark, SF001).collect()))
        b = sorted(map(tuple, q[name](spark, SF001).collect()))
        assert a == b, name
