"""Calendar parts of a date."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES = [
    "day_of_week", "day_of_month", "month", "week_of_year", "t",
    "dow_sin", "dow_cos", "month_sin", "month_cos",
]


def monday_week(d: Column) -> Column:
    """Week of the year, weeks start on Monday and days before the first Monday are week 0."""
    return F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")


def fiscal_year(d: Column) -> Column:
    """Years start in April and are named after the calendar year of that April."""
    return F.year(F.add_months(d, -3))


def fiscal_quarter(d: Column) -> Column:
    return F.quarter(F.add_months(d, -3))


def date_id(d: Column) -> Column:
    """yyyymmdd as a number: a date key that needs no lookup."""
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def time_features(d: Column, start: Column) -> dict[str, Column]:
    """The nine regression features of a day; `start` is the day where t is 0."""
    dow, month = F.weekday(d), F.month(d)
    week_angle = F.lit(2 * math.pi) * dow / F.lit(7.0)
    year_angle = F.lit(2 * math.pi) * month / F.lit(12.0)
    values = [
        dow, F.dayofmonth(d), month, F.weekofyear(d), F.datediff(d, start),
        F.sin(week_angle), F.cos(week_angle), F.sin(year_angle), F.cos(year_angle),
    ]
    return {name: value.cast("double") for name, value in zip(FEATURES, values)}
