"""Reports over daily employee hours.

Functions without a suffix take hours of the file upload (`clean_workforce`); those
ending in `_records` take hours of the record load (`clean_operations_records`).

Departments are joined after the aggregation: the fact carries the department code, so
the join sees one row per group instead of the whole fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators.periods import (
    CURRENT, PRIOR, as_date, label_periods, of_period, within,
)

DAY = "date"


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _sum2(name: str) -> Column:
    return _zero(C.rounded(F.sum(name), 2))


def _absences(name: str = "absent") -> Column:
    return F.count_if(F.col(name))


def nonzero(capacity: Column) -> Column:
    """Capacity as a divisor: 1 where it is 0 or unknown, and never below 0.01."""
    known = F.when(F.coalesce(capacity, F.lit(0.0)) == 0, 1.0).otherwise(capacity)
    return F.greatest(known, F.lit(0.01))


def utilization_avg() -> Column:
    return _zero(C.rounded(F.avg("utilization_rate") * 100, 1))


def classify_status(pct: Column) -> Column:
    return (
        F.when(pct >= 95, "over_capacity").when(pct >= 80, "optimal")
        .when(pct >= 60, "underutilized").otherwise("critical_underutilization")
    )


def classify_gap(gap: Column, capacity: Column) -> Column:
    share = gap / F.greatest(capacity, F.lit(0.01))
    return F.when(share > 0.25, "critical").when(share > 0.15, "warning").otherwise("low")


def named(per: DataFrame, departments: DataFrame) -> DataFrame:
    """Inner join of an aggregate with the department dimension, for the name."""
    names = departments.select(
        F.col("code").alias("department_code"), F.col("name").alias("department_name")
    )
    return per.join(names, "department_code")


# --- reports of the file upload -------------------------------------------------
def workforce_summary(hours: DataFrame, start, end, department: str | None = None) -> DataFrame:
    rows = within(hours, DAY, start, end, department_code=department)
    totals = rows.filter(F.col("department_code").isNotNull()).agg(
        F.count_distinct("employee_id").alias("total_employees"),
        _sum2("scheduled_hours").alias("total_scheduled_hours"),
        _sum2("actual_hours").alias("total_actual_hours"),
        utilization_avg().alias("avg_utilization_pct"),
        _sum2("overtime_hours").alias("total_overtime_hours"),
        _absences().alias("total_absences"),
        _zero(C.rounded(F.avg("demand_units"), 2)).alias("avg_demand"),
        _zero(C.rounded(F.avg("capacity_units"), 2)).alias("avg_capacity"),
    )
    people = F.greatest(F.col("total_employees"), F.lit(1))
    coverage = F.col("avg_demand") / nonzero(F.col("avg_capacity")) * 100
    return totals.select(
        F.lit(as_date(start)).alias("period_start"), F.lit(as_date(end)).alias("period_end"),
        *totals.columns,
        F.round(F.col("total_absences") / people * 100, 1).alias("absence_rate_pct"),
        F.round(coverage, 1).alias("demand_coverage_pct"),
    )


def workforce_by_department(hours: DataFrame, departments: DataFrame, start, end) -> DataFrame:
    per = within(hours, DAY, start, end).groupBy("department_code").agg(
        F.count_distinct("employee_id").alias("headcount"),
        _sum2("scheduled_hours").alias("scheduled_hours"),
        _sum2("actual_hours").alias("actual_hours"),
        utilization_avg().alias("utilization_pct"),
        _sum2("overtime_hours").alias("overtime_hours"),
        _absences().alias("absence_count"),
        _sum2("demand_units").alias("demand_units"),
        _sum2("capacity_units").alias("capacity_units"),
    )
    capacity = F.greatest(F.col("capacity_units"), F.lit(0.01))
    return named(per, departments).withColumns({
        "demand_coverage_pct": F.round(F.col("demand_units") / capacity * 100, 1),
        "staffing_status": classify_status(F.col("utilization_pct")),
    }).orderBy(F.desc_nulls_first("utilization_pct"), "department_code")


def utilization_heatmap(hours: DataFrame, departments: DataFrame, start, end) -> DataFrame:
    per = within(hours, DAY, start, end).groupBy("date", "department_code").agg(
        utilization_avg().alias("utilization_pct"),
        F.count_distinct("employee_id").alias("headcount"),
        _absences().alias("absences"),
    )
    return named(per, departments).orderBy("date", "department_code")


def staffing_gaps(
    hours: DataFrame, departments: DataFrame, start, end, limit: int = 100
) -> DataFrame:
    """Days and departments whose demand exceeds 105 % of capacity, largest gap first.

    Sums are cut to six places before they are compared: the order in which a cluster adds
    doubles must not decide what passes the threshold or the limit.
    """
    per = within(hours, DAY, start, end).groupBy("date", "department_code").agg(
        F.round(F.sum("demand_units"), 6).alias("demand"),
        F.round(F.sum("capacity_units"), 6).alias("capacity"),
    ).filter(F.col("demand") > F.round(F.col("capacity") * 1.05, 6))
    gap, capacity = F.col("gap"), F.col("capacity")
    top = named(per, departments).withColumn("gap", F.round(F.col("demand") - capacity, 6))
    return top.orderBy(F.desc_nulls_first("gap"), "date", "department_code").limit(limit).select(
        "date", "department_code", "department_name", "demand", "capacity", "gap",
        F.round(gap / nonzero(capacity) * 100, 1).alias("gap_pct"),
        classify_gap(gap, nonzero(capacity)).alias("severity"),
    )


# --- reports of the record load ---------------------------------------------------
def _utilization() -> Column:
    return C.rounded(F.avg("utilization_pct"), 1)


def absence_rows_pct() -> Column:
    return F.round(C.ratio(100.0 * _absences("is_absent"), F.count("*")), 1)


def workforce_overview_records(
    hours: DataFrame, start, end, department: str | None = None
) -> DataFrame:
    """Headline numbers and their change against the period before, in one scan."""
    rows = hours if department is None else hours.filter(F.col("department_code") == department)
    per = label_periods(rows, DAY, start, end, "overview").groupBy("period").agg(
        F.count_distinct("employee_code").alias("headcount"),
        _utilization().alias("avg_utilization_pct"),
        C.rounded(F.sum("overtime_hours"), 1).alias("total_overtime_hours"),
        absence_rows_pct().alias("absence_rate_pct"),
        F.sum("tasks_completed").alias("total_tasks"),
        C.rounded(F.avg("actual_hours"), 2).alias("avg_actual_hours"),
    )
    measures = [c for c in per.columns if c != "period"]
    both = per.agg(
        *[of_period(CURRENT, m).alias(m) for m in measures],
        of_period(PRIOR, "headcount").alias("_headcount"),
        of_period(PRIOR, "avg_utilization_pct").alias("_utilization"),
    )
    now, before = F.col("avg_utilization_pct"), F.col("_utilization")
    return both.withColumn("headcount", F.coalesce("headcount", F.lit(0))).withColumns({
        "headcount_change": F.col("headcount") - F.coalesce("_headcount", F.lit(0)),
        "utilization_change_pct": F.when((now != 0) & (before != 0), F.round(now - before, 1)),
    }).drop("_headcount", "_utilization")


def daily_workforce_measures(hours: DataFrame) -> DataFrame:
    return hours.groupBy("date").agg(
        F.count_distinct("employee_code").alias("headcount"),
        _utilization().alias("avg_utilization_pct"),
        F.round(F.sum("overtime_hours"), 6).alias("overtime_hours"),
        _absences("is_absent").alias("absent_count"),
    )


def workforce_daily_records(
    hours: DataFrame, start, end, department: str | None = None
) -> DataFrame:
    rows = hours if department is None else hours.filter(F.col("department_code") == department)
    return daily_workforce_measures(within(rows, DAY, start, end)).orderBy("date")


def workforce_by_department_records(
    hours: DataFrame, departments: DataFrame, start, end
) -> DataFrame:
    """By department name; hours of employees without a department drop out of the join."""
    per = named(
        within(hours, DAY, start, end).groupBy("department_code", "employee_code").agg(
            F.sum("utilization_pct").alias("_util"), F.count("utilization_pct").alias("_known"),
            F.sum("tasks_completed").alias("_tasks"),
            _absences("is_absent").alias("_absent"), F.count("*").alias("_rows"),
        ), departments
    ).groupBy(F.col("department_name").alias("department")).agg(
        F.count_distinct("employee_code").alias("headcount"),
        C.rounded(C.ratio(F.sum("_util"), F.sum("_known")), 1).alias("avg_utilization_pct"),
        F.sum("_tasks").alias("total_tasks"),
        F.round(C.ratio(100.0 * F.sum("_absent"), F.sum("_rows")), 1).alias("absence_rate_pct"),
    )
    return per.orderBy(F.desc_nulls_first("avg_utilization_pct"), "department")
