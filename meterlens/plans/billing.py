"""Billing (family E): a unified cost ledger and a linear usage forecast."""

from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import (
    LEDGER_GROUPS, MEASURE_ACTUAL, MEASURE_CONTRACT, MEASURE_PROJECTED, STORAGE_DOLLARS_PER_TB_MONTH,
)
from ..functions.time import add_months, as_datetime, ts_lit
from ..operators.calendar import calendar_days
from ..sources.tables import Tables

LEDGER_COLUMNS = [
    "warehouse_group_name", "warehouse_name", "group_contact", "group_cost_center", "group_comment",
    "start_time", "end_time", "credits_used", "credit_price", "dollars_used", "measure_type",
]
# Credits have nine decimals and prices two, so dollars have eleven.
AMOUNT = "decimal(38,11)"
PRICE = "decimal(10,2)"
_TB = 1024 ** 4


class Contract:
    """Contract terms: price per credit, start, length in months, amount.

    Per-day figures are scalars of the parameters, computed exactly here and
    passed to Spark as decimal literals.
    """

    def __init__(self, credit_price: float | str = "4.00", term_start: dt.date | str = "2019-01-01",
                 term_months: int = 12, term_amount: float | str = "100000.00", inclusive_end: bool = True):
        self.price = Decimal(str(credit_price)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        self.amount = Decimal(str(term_amount)).quantize(Decimal("1"), ROUND_HALF_UP)
        self.start = as_datetime(term_start)
        end = add_months(self.start, term_months)
        # The ledger runs to start + term (inclusive); the forecast stops a day earlier.
        self.end = end if inclusive_end else end - dt.timedelta(days=1)
        self.days = (self.end.date() - self.start.date()).days

    def _per_day(self, value: Decimal) -> Column:
        with localcontext() as ctx:
            ctx.prec = 60
            exact = (value / self.days).quantize(Decimal("0.00000000001"), ROUND_HALF_UP)
        return F.lit(exact).cast(AMOUNT)

    def dollars_per_day(self) -> Column:
        return self._per_day(self.amount)

    def credits_per_day(self) -> Column:
        with localcontext() as ctx:
            ctx.prec = 60
            credits = self.amount / self.price
        return self._per_day(credits)


def _branch(df: DataFrame, group: str | None, name: Column, start: Column, end: Column, credits: Column | None,
            price: Decimal, dollars: Column, measure: str) -> DataFrame:
    null_s = F.lit(None).cast("string")
    return df.select(
        F.lit(group).cast("string").alias("warehouse_group_name"), name.cast("string").alias("warehouse_name"),
        null_s.alias("group_contact"), null_s.alias("group_cost_center"), null_s.alias("group_comment"),
        start.cast("timestamp_ntz").alias("start_time"), end.cast("timestamp_ntz").alias("end_time"),
        (credits if credits is not None else F.lit(None)).cast(AMOUNT).alias("credits_used"),
        F.lit(price).cast(PRICE).alias("credit_price"), dollars.cast(AMOUNT).alias("dollars_used"),
        F.lit(measure).alias("measure_type"),
    )


def _object_name() -> Column:
    return F.concat(F.col("database_name"), F.lit("."), F.col("schema_name"), F.lit("."), F.col("table_name"))


def actual_costs(t: Tables, credit_price: float | str = "4.00", lo: dt.datetime | None = None,
                 hi: dt.datetime | None = None) -> DataFrame:
    """The seven metered cost lines: warehouses, five serverless features, storage.

    A union of narrow projections: no shuffle.  Storage is priced per
    TB-month and spread over the days of its month.  With ``lo``/``hi`` only
    lines starting in ``[lo, hi)`` are read (each table is bounded at its
    source, so the time range reaches every scan).
    """
    price = Decimal(str(credit_price)).quantize(Decimal("0.01"))
    p = F.lit(price).cast(PRICE)
    bounded = lo is not None or hi is not None

    def read(table: str) -> DataFrame:
        return t.between(table, lo, hi) if bounded else t[table]

    def metered(table: str, group: str, name: Column) -> DataFrame:
        df = read(table)
        return _branch(df, group, name, F.col("start_time"), F.col("end_time"), F.col("credits_used"), price,
                       p * F.col("credits_used"), MEASURE_ACTUAL)

    names = {
        "warehouse_metering_history": F.col("warehouse_name"), "pipe_usage_history": F.col("pipe_name"),
        "automatic_clustering_history": _object_name(), "materialized_view_refresh_history": _object_name(),
        "search_optimization_history": _object_name(), "replication_usage_history": F.col("database_name"),
    }
    groups = dict(LEDGER_GROUPS)
    parts = [metered(table, groups[table], name) for table, name in names.items()]
    su = read("storage_usage")
    days_in_month = F.dayofmonth(F.last_day("usage_date"))
    total_bytes = F.col("storage_bytes") + F.col("stage_bytes") + F.col("failsafe_bytes")
    storage_dollars = total_bytes / F.lit(float(_TB)) * STORAGE_DOLLARS_PER_TB_MONTH / days_in_month
    storage = groups["storage_usage"]
    parts.append(_branch(su, storage, F.lit(storage), F.col("usage_date"), F.col("usage_date"), None, price,
                         storage_dollars, MEASURE_ACTUAL))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def billing_ledger(t: Tables, credit_price: float | str = "4.00", term_start: dt.date | str = "2019-01-01",
                   term_months: int = 12, term_amount: float | str = "100000.00") -> DataFrame:
    """Every cost line, one projected line per contract day, and the contract total.

    The projected lines come from a generated calendar of exactly the
    contract days (start to start + term, inclusive), so the source's range
    join to a date table disappears.
    """
    c = Contract(credit_price, term_start, term_months, term_amount, inclusive_end=True)
    days = calendar_days(t["warehouse_metering_history"].sparkSession, c.start.date(), c.end.date())
    day_ts = F.col("d_date").cast("timestamp_ntz")
    projected = _branch(days, None, F.lit(None), day_ts, day_ts, c.credits_per_day(), c.price, c.dollars_per_day(),
                        MEASURE_PROJECTED)
    contract = _branch(days.sparkSession.range(1), None, F.lit(None), F.lit(None), F.lit(None), None, c.price,
                       F.lit(c.amount), MEASURE_CONTRACT)
    return actual_costs(t, credit_price).unionByName(projected).unionByName(contract).select(*LEDGER_COLUMNS)


def usage_forecast(t: Tables, credit_price: float | str = "4.00", term_start: dt.date | str = "2020-01-01",
                   term_months: int = 12, term_amount: float | str = "100000.00") -> DataFrame:
    """Per contract day: contracted dollars, actual dollars and a linear forecast.

    Actual dollars are summed per day (partial aggregation collapses the
    ledger to one row per day per task before the shuffle).  The line is
    fitted by the built-in regression aggregates over the contract days that
    have actuals and evaluated on every contract day; without at least two
    such days there is no line and the forecast is NULL.
    """
    c = Contract(credit_price, term_start, term_months, term_amount, inclusive_end=False)
    # Only contract days matter: this filter is pushed through the union
    # into every one of the seven scans.
    in_term = ((F.col("start_time") >= ts_lit(c.start))
               & (F.col("start_time") < ts_lit(c.end + dt.timedelta(days=1))))
    lines = actual_costs(t, credit_price, c.start, c.end + dt.timedelta(days=1)).filter(in_term)
    actual = lines.groupBy(F.to_date("start_time").alias("consumption_date")).agg(
        F.sum("dollars_used").cast(AMOUNT).alias("actual_dollars_used"))
    return forecast_days(t["warehouse_metering_history"].sparkSession, c, actual)


def forecast_days(spark: SparkSession, c: Contract, actual: DataFrame) -> DataFrame:
    """The forecast from the actual dollars per day (consumption_date, actual_dollars_used) of the term.

    The line is fitted in the aggregate that gathers the calendar, which has
    one row per contract day, so the actuals are computed once.
    """
    days = calendar_days(spark, c.start.date(), c.end.date(), name="consumption_date")
    # Both sides hold at most one row per contract day (the actuals are
    # filtered to the term), so broadcasting the actuals is size-bounded.
    joined = days.join(F.broadcast(actual), on="consumption_date", how="left")
    x = F.datediff(F.col("consumption_date"), F.lit(c.start.date())).cast("double")
    y = F.col("actual_dollars_used").cast("double")
    term = joined.agg(F.collect_list(F.struct("consumption_date", "actual_dollars_used")).alias("days"),
                      F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return term.select(F.inline("days"), "slope", "intercept").select(
        "consumption_date",
        c.dollars_per_day().alias("contracted_dollars_used"),
        "actual_dollars_used",
        (x * F.col("slope") + F.col("intercept")).alias("forecasted_dollars_used"),
    ).orderBy("consumption_date")
