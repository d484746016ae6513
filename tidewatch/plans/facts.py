"""Cleaned facts that the named queries start from, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.operators import cleaning, market, tickets, validation
from tidewatch.sources import feeds

AS_OF = "2024-01-31 00:00:00"
# days from the last date of the hours to the last date of the tickets
SHIFT_DAYS = 8122


def ticket_facts(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    cleaned = cleaning.clean_tickets(feeds.raw_tickets(spark, sf_dir, repeated), AS_OF)
    return tickets.with_created_date(cleaned.clean)


def ticket_records(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    feed = feeds.raw_ticket_records(spark, sf_dir, repeated)
    valid = validation.validate(feed, "ticket").valid
    return tickets.with_created_date(cleaning.clean_ticket_records(valid))


def hour_facts(spark: SparkSession, sf_dir: str, shift_days: int = 0) -> DataFrame:
    return cleaning.clean_workforce(feeds.raw_workforce(spark, sf_dir, shift_days)).clean


def hour_records(spark: SparkSession, sf_dir: str, shift_days: int = 0) -> DataFrame:
    feed = feeds.raw_operations_records(spark, sf_dir, shift_days)
    return cleaning.clean_operations_records(validation.validate(feed, "operations").valid)


def signal_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = cleaning.clean_market_signals(feeds.raw_market(spark, sf_dir))
    return market.with_signal_columns(cleaned.clean)


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.raw_employees(spark, sf_dir)
    return cleaning.clean_employees(validation.validate(feed, "employee").valid)


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Department dimension of the hours: one per region, and the unknown member."""
    regions = feeds.table(spark, sf_dir, "region").select(
        F.concat(F.lit("D"), F.col("r_regionkey").cast("string")).alias("code"),
        C.title_case(F.col("r_name")).alias("name"),
    )
    unknown = V.DEFAULT_DEPARTMENT
    return regions.unionByName(
        regions.limit(1).select(F.lit(unknown).alias("code"),
                                C.title_case(F.lit(unknown)).alias("name"))
    )
