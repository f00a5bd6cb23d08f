"""Where telemetry comes from: declared schemas, the ``Tables`` resolver and
the bridge that derives telemetry from the benchmark tables."""

from .bridge import DriverBridge, driver_tables
from .tables import PARTITIONING, SCHEMAS, Tables, conform

__all__ = ["PARTITIONING", "SCHEMAS", "DriverBridge", "Tables", "conform", "driver_tables"]
