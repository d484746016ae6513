"""Reports over market signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators.dedup import ROW_INDEX
from tidewatch.operators.periods import within

SIGNAL_COLUMNS = [
    "signal_date", "source", "category", "subcategory", "region", "industry", "value",
    "value_label", "change_pct", "notes",
]
SIGNAL_TEXTS = ["subcategory", "region", "industry", "value_label", "notes"]


def with_signal_columns(signals: DataFrame) -> DataFrame:
    """Add the optional text columns a feed may lack; blank text is NULL."""
    return signals.withColumns(
        {c: C.blank_to_null(C.first_present(signals, c)) for c in SIGNAL_TEXTS}
    )


def market_signals(
    signals: DataFrame, start, end, category: str | None = None, limit: int = 200
) -> DataFrame:
    """The latest signals; those of one day in feed order."""
    rows = within(signals, "signal_date", start, end, category=category)
    return rows.orderBy(F.desc("signal_date"), ROW_INDEX).limit(limit).select(*SIGNAL_COLUMNS)


def change_by_industry(signals: DataFrame) -> DataFrame:
    """Mean change per known industry, highest first."""
    return signals.filter(F.col("industry").isNotNull()).groupBy("industry").agg(
        C.rounded(F.avg("change_pct"), 2).alias("avg_change")
    ).orderBy(F.desc("avg_change"), "industry")


def signals_by_category(signals: DataFrame, newest: int = 200) -> DataFrame:
    """Count of signals and of sources per category, and a list of its `newest` signals.

    Counts cover all signals given; the list's length is the caller's choice, so that no category's
    rows are collected whole.
    """
    counts = signals.groupBy("category").agg(
        F.count("*").alias("signal_count"), F.countDistinct("source").alias("sources"))
    latest = Window.partitionBy("category").orderBy(
        F.desc("signal_date"), "source", "value", "change_pct")
    signal = F.struct("signal_date", "source", "value", "change_pct")
    lists = (
        signals.withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= newest)
        .groupBy("category")
        .agg(F.array_sort(F.collect_list(signal)).alias("signals"))
    )
    of = F.col("category").eqNullSafe(F.col("_of"))
    lists = lists.withColumnRenamed("category", "_of")
    return counts.join(lists, of).drop("_of").orderBy("category")
