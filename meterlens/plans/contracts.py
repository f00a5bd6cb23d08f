"""Ledger and daily commitments of many contracts, whose terms may overlap."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MEASURE_CONTRACT, MEASURE_PROJECTED
from ..operators.calendar import calendar_days
from ..operators.intervals import points_in_intervals
from ..sources.tables import Tables
from .billing import AMOUNT, LEDGER_COLUMNS, PRICE, actual_costs


def _calendar(contracts: DataFrame) -> DataFrame:
    """Every day from the first start to the last end of ``contracts``; one day at most without any."""
    span = contracts.filter("term_start <= term_end").agg(F.min("term_start").alias("a"), F.max("term_end").alias("b"))
    days = F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))
    return span.filter("a IS NOT NULL").select(F.explode(days).alias("d_date"))


def contract_days(contracts: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Every contract on every day of its term, both ends included, with its dollars and credits per day.

    ``contracts``: contract_id, term_start, term_end (dates), credit_price,
    term_amount.  ``days``: dates (d_date) to look at, all of the terms by
    default.  Terms may overlap or lie apart; one that ends before it starts
    has no day.  An amount is spread over the days between start and end, as
    the ledger of a single contract does; a term of one day has it whole.
    """
    terms = contracts.filter("term_start <= term_end")
    met = points_in_intervals(_calendar(terms) if days is None else days, terms, point="d_date", span=("term_start", "term_end"))
    n = F.greatest(F.datediff("term_end", "term_start"), F.lit(1)).cast("decimal(10,0)")
    amount = F.col("term_amount").cast("decimal(18,2)")
    return met.withColumn("dollars_per_day", (amount / n).cast(AMOUNT)).withColumn(
        "credits_per_day", F.try_divide(F.try_divide(amount, F.col("credit_price").cast(PRICE)), n).cast(AMOUNT))


def contracts_ledger(t: Tables, contracts: DataFrame, credit_price: float | str = "4.00") -> DataFrame:
    """Every cost line, one projected line per contract and day, and one line per contract with its total.

    As ``billing_ledger``, for a table of contracts; ``contract_id`` (null on
    cost lines) is added to its columns.
    """
    def lines(df: DataFrame, start: Column, credits: Column, dollars: Column, measure: str) -> DataFrame:
        given = {"start_time": start.cast("timestamp_ntz"), "end_time": start.cast("timestamp_ntz"), "credits_used": credits.cast(AMOUNT),
                 "credit_price": F.col("credit_price").cast(PRICE), "dollars_used": dollars.cast(AMOUNT), "measure_type": F.lit(measure)}
        return df.select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in LEDGER_COLUMNS],
                         F.col("contract_id").cast("string").alias("contract_id"))

    projected = lines(contract_days(contracts), F.col("d_date"), F.col("credits_per_day"), F.col("dollars_per_day"), MEASURE_PROJECTED)
    totals = lines(contracts, F.lit(None).cast("date"), F.lit(None), F.col("term_amount"), MEASURE_CONTRACT)
    actual = actual_costs(t, credit_price).withColumn("contract_id", F.lit(None).cast("string"))
    return actual.unionByName(projected).unionByName(totals).select("contract_id", *LEDGER_COLUMNS)


def contracted_by_day(contracts: DataFrame) -> DataFrame:
    """Per day: contracts in force and the dollars and credits they commit."""
    return contract_days(contracts).groupBy(F.col("d_date").alias("consumption_date")).agg(
        F.count(F.lit(1)).alias("contracts"), F.sum("dollars_per_day").cast(AMOUNT).alias("contracted_dollars_used"),
        F.sum("credits_per_day").cast(AMOUNT).alias("contracted_credits_used"))


def contract_frame(t: Tables, *terms: tuple[str, dt.date, dt.date, Decimal | str, Decimal | str]) -> DataFrame:
    """A contracts table from (contract_id, term_start, term_end, credit_price, term_amount) rows."""
    rows = [(i, a, b, Decimal(str(p)), Decimal(str(m))) for i, a, b, p, m in terms]
    return t["warehouse_metering_history"].sparkSession.createDataFrame(
        rows, f"contract_id string, term_start date, term_end date, credit_price {PRICE}, term_amount decimal(18,2)")
