"""meterlens: cost, usage and performance reports over data-platform telemetry,
as lazy Spark DataFrames.

    from meterlens import REPORTS, Tables, run_section
    t = Tables.from_parquet(spark, "/data/telemetry")
    df = REPORTS["credits_by_user"](t, as_of=datetime(2024, 2, 15))
    usage = run_section(t, "usage", as_of=datetime(2024, 2, 15), tier=1)
"""

from .functions import to_output
from .plans import REPORTS
from .plans.catalog import SECTIONS, TIERS, run_report, run_section
from .sources import SCHEMAS, Tables, driver_tables

__all__ = ["REPORTS", "SCHEMAS", "SECTIONS", "TIERS", "Tables", "driver_tables", "run_report", "run_section",
           "to_output"]
