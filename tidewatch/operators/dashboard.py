"""Shapes that the dashboards show: matrices, splits, flags and pages over small reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators.anomaly import severity_rank


def latest_days(report: DataFrame, days: int, column: str = "date") -> DataFrame:
    """The last distinct days of a report, numbered 1 for the oldest: at most `days` rows."""
    last = report.select(column).distinct().orderBy(F.desc(column)).limit(days)
    return last.withColumn("slot", F.row_number().over(Window.orderBy(column)))


def heatmap_matrix(heatmap: DataFrame, days: int = 14) -> DataFrame:
    """Utilisation per department over the last days, one column per day, 0 where none.

    The columns are numbered (day_01 is the oldest), so no list of dates has to be fetched
    before the query can be planned.
    """
    # the limit bounds the broadcast side to `days` rows
    slots = F.broadcast(latest_days(heatmap, days))
    cells = heatmap.join(slots, "date", "left")
    names = [F.max(F.when(F.col("slot") == i, F.col("utilization_pct"))) for i in range(1, days + 1)]
    return cells.groupBy("department_code").agg(
        *[F.coalesce(c, F.lit(0.0)).alias(f"day_{i:02d}") for i, c in enumerate(names, start=1)])


def utilization_band(pct: Column) -> Column:
    return (
        F.when(pct >= 95, "red").when(pct >= 80, "green").when(pct >= 60, "amber").otherwise("red")
    )


def split_forecast(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fitted and forecast values as two columns, with the first forecast day of the series."""
    future = F.col("is_forecast")
    start = F.min(F.when(future, F.col("ds"))).over(Window.partitionBy(*by))
    return points.withColumns({
        "actual": F.when(~future, F.col("predicted")),
        "forecast": F.when(future, F.col("predicted")), "split_date": start,
    })


def with_deviation(anomalies: DataFrame) -> DataFrame:
    return anomalies.withColumn("deviation", F.col("observed_value") - F.col("expected_value"))


def by_severity(anomalies: DataFrame, *then: str) -> DataFrame:
    """Critical first, low last."""
    return anomalies.orderBy(severity_rank(F.col("severity")), *then)


def priority_rank(priority: Column) -> Column:
    """critical 0, high 1, medium 2 and anything else 3."""
    order = {"critical": 0, "high": 1, "medium": 2}
    return F.coalesce(C.map_values(priority, order), F.lit(3))


def by_priority(rows: DataFrame, *then: str) -> DataFrame:
    return rows.orderBy(priority_rank(F.col("priority")), *then)


def sla_compliance(breach_rate_pct: Column) -> Column:
    return 100 - breach_rate_pct


def workforce_flags(summary: DataFrame) -> DataFrame:
    return summary.withColumns({
        "utilization_alert": F.col("avg_utilization_pct") > 90,
        "overtime_alert": F.col("total_overtime_hours") > 200,
    })


def ticket_flags(summary: DataFrame) -> DataFrame:
    return summary.withColumns({
        "breach_alert": F.col("sla_breach_rate_pct") > 20,
        "critical_alert": F.col("critical_open") > 0,
        "sla_compliance_pct": F.round(sla_compliance(F.col("sla_breach_rate_pct")), 1),
    })


def page(rows: DataFrame, order: Sequence[str | Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of a result in a total order."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    total = F.count("*")
    return rows.agg(total.alias("total"), F.ceil(total / size).alias("pages"))
