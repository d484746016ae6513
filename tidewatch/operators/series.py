"""Daily series in long form: key columns, `ds` (date) and `y` (double).

A series has at most one row per calendar day, so a window over one series is bounded by the
calendar however large the facts are; the facts themselves are only aggregated. All functions
take `by`, the key columns, and work on any number of series in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.periods import within

HOUR_METRICS = {
    "demand_units": lambda: F.sum("demand_units"),
    "utilization_rate": lambda: F.avg("utilization_rate") * 100,
    "absent": lambda: F.count_if("absent").cast("double"),
}
TICKET_METRIC = "ticket_volume"
METRICS = [TICKET_METRIC, *HOUR_METRICS]


def metric_series(
    hours: DataFrame | None, tickets: DataFrame | None, metric: str, start, end,
    department: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """One measure per day and key; days without rows have none."""
    if metric == TICKET_METRIC:
        rows = within(tickets, "created_date", start, end, department_code=department)
        return rows.groupBy(*by, F.col("created_date").alias("ds")).agg(
            F.count("*").cast("double").alias("y"))
    if metric not in HOUR_METRICS:
        raise ValueError(f"Unknown metric: {metric}")
    rows = within(hours, "date", start, end, department_code=department)
    measure = F.coalesce(HOUR_METRICS[metric](), F.lit(0.0))
    return rows.groupBy(*by, F.col("date").alias("ds")).agg(F.round(measure, 9).alias("y"))


def all_metric_series(
    hours: DataFrame, tickets: DataFrame, start, end, by: Sequence[str] = ()
) -> DataFrame:
    """Every measure as series keyed by `metric` and `by`; each fact is read once."""
    measures = [F.coalesce(F.round(m(), 9), F.lit(0.0)).alias(n) for n, m in HOUR_METRICS.items()]
    per = within(hours, "date", start, end).groupBy(*by, F.col("date").alias("ds")).agg(*measures)
    long = per.unpivot([*by, "ds"], list(HOUR_METRICS), "metric", "y")
    volume = metric_series(None, tickets, TICKET_METRIC, start, end, by=by)
    return long.unionByName(volume.withColumn("metric", F.lit(TICKET_METRIC)))


# --- windows over one series ------------------------------------------------------
def whole(by: Sequence[str]):
    return Window.partitionBy(*by)


def in_order(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("ds")


def around(by: Sequence[str], days: int = 3):
    """The rows up to `days` positions before and after the current one."""
    return in_order(by).rowsBetween(-days, days)


def at_least(count: Column, minimum: int, value: Column) -> Column:
    return F.when(count >= minimum, value)


def spread(deviation: Column) -> Column:
    """A standard deviation as divisor: NULL where there is none to speak of."""
    return F.when(deviation >= 1e-9, deviation)


def rolling_mean(by: Sequence[str], value: str = "y", minimum: int = 3) -> Column:
    return at_least(F.count(value).over(around(by)), minimum, F.avg(value).over(around(by)))


def rolling_std(by: Sequence[str], value: str = "y", minimum: int = 3) -> Column:
    std = spread(F.stddev_samp(value).over(around(by)))
    return at_least(F.count(value).over(around(by)), minimum, std)


def position(by: Sequence[str]) -> Column:
    """0, 1, 2, … along a series; gaps in the dates do not count."""
    return F.row_number().over(in_order(by)) - 1


def days_from_start(by: Sequence[str]) -> Column:
    return F.datediff("ds", F.min("ds").over(whole(by)))


def tail(series: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The last n rows of every series."""
    latest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ds")))
    return series.withColumn("_back", latest).filter(F.col("_back") <= n).drop("_back")


def keyed(series: DataFrame, by: Sequence[str], day: str = "ds") -> tuple[DataFrame, list[str]]:
    """The key columns; a lone series gets one that is 0 in all rows, so that it can be joined.

    It is computed from the day: a literal would be folded, and the joins on it would become
    cross joins.
    """
    if by:
        return series, list(by)
    return series.withColumn("_series", F.pmod(F.weekday(day), F.lit(1))), ["_series"]
