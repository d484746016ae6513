"""Daily partial aggregates beside the facts, and the reports that need nothing else.

Every load adds the partial rows of what it wrote, one for each day (and department), so a report over a period adds
up a few rows a day and load instead of reading facts. Only measures that add up are kept: counts, and sums
with the number of values behind them. Distinct people and percentiles do not add up; they are taken from the
facts of the period's months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators.periods import as_date, within
from tidewatch.operators.workforce import DAY as HOURS_DAY
from tidewatch.operators.workforce import classify_gap, named, nonzero

TICKET_DAY = "created_date"
SUMS = ("scheduled_hours", "actual_hours", "overtime_hours", "utilization_rate", "demand_units", "capacity_units")


def ticket_days(facts: DataFrame) -> DataFrame:
    """created_date, created_count, resolved_count, sentiment_sum, sentiment_n of some loaded tickets."""
    return facts.groupBy(TICKET_DAY).agg(
        F.count("*").alias("created_count"),
        F.count_if(F.col("status").isin("resolved", "closed")).alias("resolved_count"),
        F.sum("sentiment_score").alias("sentiment_sum"),
        F.count("sentiment_score").alias("sentiment_n"),
    )


def operations_days(facts: DataFrame) -> DataFrame:
    """date, department_code, row and absence counts, and sum and number of each measure, of some loaded hours."""
    parts = [e for c in SUMS for e in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))]
    return facts.groupBy(HOURS_DAY, "department_code").agg(
        F.count("*").alias("rows"), F.count_if("absent").alias("absences"), *parts)


ROLLUPS = {
    "fact_ticket": ("daily_ticket", ticket_days),
    "fact_operations": ("daily_operations", operations_days),
}


def _sum2(name: str) -> Column:
    return F.coalesce(C.rounded(F.sum(f"{name}_sum"), 2), F.lit(0.0))


def _mean(name: str, places: int, scale: int = 1) -> Column:
    mean = C.ratio(F.sum(f"{name}_sum"), F.sum(f"{name}_n")) * scale
    return F.coalesce(C.rounded(mean, places), F.lit(0.0))


def ticket_trends(days: DataFrame, start, end) -> DataFrame:
    """`tickets.ticket_trends` from the partial rows of the period."""
    per = within(days, TICKET_DAY, start, end).groupBy(F.col(TICKET_DAY).alias("date")).agg(
        F.sum("created_count").alias("created_count"), F.sum("resolved_count").alias("resolved_count"),
        C.rounded(C.ratio(F.sum("sentiment_sum"), F.sum("sentiment_n")), 2).alias("avg_sentiment"),
    )
    running = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("net_change", F.col("created_count") - F.col("resolved_count"))
    return per.withColumn(
        "cumulative_open", F.greatest(F.sum("net_change").over(running), F.lit(0))).orderBy("date")


def staffing_gaps(days: DataFrame, departments: DataFrame, start, end, limit: int = 100) -> DataFrame:
    """`workforce.staffing_gaps` from the partial rows of the period."""
    per = within(days, HOURS_DAY, start, end).groupBy("date", "department_code").agg(
        F.round(F.sum("demand_units_sum"), 6).alias("demand"),
        F.round(F.sum("capacity_units_sum"), 6).alias("capacity"),
    ).filter(F.col("demand") > F.round(F.col("capacity") * 1.05, 6))
    gap, capacity = F.col("gap"), F.col("capacity")
    top = named(per, departments).withColumn("gap", F.round(F.col("demand") - capacity, 6))
    return top.orderBy(F.desc_nulls_first("gap"), "date", "department_code").limit(limit).select(
        "date", "department_code", "department_name", "demand", "capacity", "gap",
        F.round(gap / nonzero(capacity) * 100, 1).alias("gap_pct"),
        classify_gap(gap, nonzero(capacity)).alias("severity"),
    )


def workforce_summary(days: DataFrame, facts: DataFrame, start, end) -> DataFrame:
    """`workforce.workforce_summary`: sums from the partial rows, people from the period's facts (one column)."""
    people = within(facts, HOURS_DAY, start, end).filter(F.col("department_code").isNotNull()).agg(
        F.count_distinct("employee_id").alias("total_employees"))
    totals = within(days, HOURS_DAY, start, end).filter(F.col("department_code").isNotNull()).agg(
        _sum2("scheduled_hours").alias("total_scheduled_hours"),
        _sum2("actual_hours").alias("total_actual_hours"),
        _mean("utilization_rate", 1, 100).alias("avg_utilization_pct"),
        _sum2("overtime_hours").alias("total_overtime_hours"),
        F.coalesce(F.sum("absences"), F.lit(0)).alias("total_absences"),
        _mean("demand_units", 2).alias("avg_demand"),
        _mean("capacity_units", 2).alias("avg_capacity"),
    )
    one = F.lit(1).alias("_one")  # both sides are one row
    both = people.select("*", one).join(totals.select("*", one), "_one").drop("_one")
    coverage = F.col("avg_demand") / nonzero(F.col("avg_capacity")) * 100
    return both.select(
        F.lit(as_date(start)).alias("period_start"), F.lit(as_date(end)).alias("period_end"), *both.columns,
        F.round(F.col("total_absences") / F.greatest(F.col("total_employees"), F.lit(1)) * 100, 1)
        .alias("absence_rate_pct"),
        F.round(coverage, 1).alias("demand_coverage_pct"),
    )
