"""Date ranges: filters and current-against-prior periods in one scan."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURRENT, PRIOR = "current", "prior"


def as_date(d: str | date) -> date:
    return d if isinstance(d, date) else date.fromisoformat(d)


def within(df: DataFrame, day: str, start, end, **equal) -> DataFrame:
    """Rows with start <= day <= end; further keyword filters apply where they are given.

    The filter names the stored date column itself, so it prunes partitions and row groups.
    """
    df = df.filter(F.col(day).between(F.lit(as_date(start)), F.lit(as_date(end))))
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def prior_period(start, end, prior: str = "equal") -> tuple[date, date]:
    """The period that `start..end` is compared with; it always ends the day before `start`.

    equal: of the same inclusive length. overview: one day shorter. insights: 7 days.
    """
    start, end = as_date(start), as_date(end)
    days = {"equal": (end - start).days + 1, "overview": (end - start).days, "insights": 7}
    if prior not in days:
        raise ValueError(f"prior must be one of {sorted(days)}, got {prior}")
    return start - timedelta(days=days[prior]), start - timedelta(days=1)


def label_periods(df: DataFrame, day: str, start, end, prior: str) -> DataFrame:
    """Rows of both periods with a `period` label: one scan instead of one per period."""
    before, _ = prior_period(start, end, prior)
    label = F.when(F.col(day) >= F.lit(as_date(start)), CURRENT).otherwise(PRIOR)
    return within(df, day, before, end).withColumn("period", label)


def of_period(period: str, column: str) -> Column:
    """Value of `column` in the row of a period, after grouping by `period`."""
    return F.max(F.when(F.col("period") == period, F.col(column)))


def change_pct(current: Column, prior: Column) -> Column:
    """Change in percent, one place; NULL without a prior value."""
    return F.round((current - prior) / F.when(prior > 0, prior) * 100, 1)
