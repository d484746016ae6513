"""Reports over support tickets.

Functions without a suffix take tickets of the file upload (`clean_tickets` plus
`created_date`); those ending in `_records` take tickets of the record load
(`clean_ticket_records` plus `created_date`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators.dashboard import priority_rank
from tidewatch.operators.periods import as_date, within
from tidewatch.operators.quantiles import exact_percentile, percentile_brackets

DAY = "created_date"


def with_created_date(tickets: DataFrame) -> DataFrame:
    return tickets.withColumn(DAY, F.col("created_at").cast("date"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _rate(part: Column, total: Column, places: int = 1) -> Column:
    """part / max(total, 1) in percent."""
    return F.round(part / F.greatest(total, F.lit(1)) * 100, places)


def _pct_or_null(part: Column, total: Column) -> Column:
    return F.round(C.ratio(100.0 * part, total), 1)


def is_open() -> Column:
    return F.col("status").isin("open", "in_progress")


# --- reports of the file upload -------------------------------------------------
def ticket_summary(tickets: DataFrame, start, end, department: str | None = None) -> DataFrame:
    """One row of counts for the period; `department` filters on its code."""
    status = F.col("status")
    totals = within(tickets, DAY, start, end, department_code=department).agg(
        F.count("*").alias("total"),
        F.count_if(status == "open").alias("open"),
        F.count_if(status == "in_progress").alias("in_progress"),
        F.count_if(status == "resolved").alias("resolved"),
        F.count_if(status == "closed").alias("closed"),
        F.count_if(F.col("sla_breached")).alias("sla_breach_count"),
        _zero(C.rounded(F.avg("actual_resolution_hours"), 2)).alias("avg_resolution_hours"),
        F.count_if((F.col("priority") == "critical") & is_open()).alias("critical_open"),
        F.count_if(F.col("escalated")).alias("escalated_count"),
    )
    return totals.select(
        F.lit(as_date(start)).alias("period_start"), F.lit(as_date(end)).alias("period_end"),
        *totals.columns,
        _rate(F.col("sla_breach_count"), F.col("total")).alias("sla_breach_rate_pct"),
    )


def ticket_trends(tickets: DataFrame, start, end) -> DataFrame:
    """Per creation day: created, resolved out of those, and the running open count.

    The running sum sees one row per calendar day, so its single partition stays small.
    """
    daily = within(tickets, DAY, start, end).groupBy(F.col(DAY).alias("date")).agg(
        F.count("*").alias("created_count"),
        F.count_if(F.col("status").isin("resolved", "closed")).alias("resolved_count"),
        C.rounded(F.avg("sentiment_score"), 2).alias("avg_sentiment"),
    )
    running = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    net = F.col("created_count") - F.col("resolved_count")
    return daily.withColumn("net_change", net).withColumn(
        "cumulative_open", F.greatest(F.sum("net_change").over(running), F.lit(0))
    ).orderBy("date")


def tickets_by_category(tickets: DataFrame, start, end) -> DataFrame:
    """Share, resolution time and breach rate per category, largest first."""
    per = within(tickets, DAY, start, end).groupBy("category").agg(
        F.count("*").alias("count"),
        _zero(C.rounded(F.avg("actual_resolution_hours"), 2)).alias("avg_resolution_hours"),
        _zero(_pct_or_null(F.count_if("sla_breached"), F.count("*"))).alias("breach_rate_pct"),
    )
    total = F.sum("count").over(Window.partitionBy())
    return per.withColumn("pct_of_total", _rate(F.col("count"), total)).orderBy(
        F.desc("count"), "category"
    )


def sla_report(tickets: DataFrame, start, end, accuracy: int = 20_000) -> DataFrame:
    """Breaches, mean and exact 95th percentile of the resolution hours per priority.

    Priorities are a fixed list of four after cleaning, so the per-group side is tiny,
    while each group may hold billions of rows: see `exact_percentile`.
    """
    by = ["priority", "sla_target_hours"]
    hours = "actual_resolution_hours"
    rows = within(tickets, DAY, start, end).select(*by, "sla_breached", hours)
    n, low, high = percentile_brackets(F.col(hours), 0.95, accuracy)
    per = rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("sla_breached").alias("breached"),
        F.avg(hours).alias("_avg"),
        n.alias("_n"), low.alias("_low"), high.alias("_high"),
    )
    p95 = exact_percentile(rows, per.select(*by, "_n", "_low", "_high"), by, hours, 0.95, "_p95",
                           few_groups=True)
    return per.join(F.broadcast(p95), by, "left").orderBy(priority_rank(F.col("priority"))).select(
        *by, "total", "breached",
        _rate(F.col("breached"), F.col("total")).alias("breach_rate_pct"),
        _zero(C.rounded(F.col("_avg"), 2)).alias("avg_resolution_hours"),
        _zero(C.rounded(F.col("_p95"), 2)).alias("p95_resolution_hours"),
    )


# --- reports of the record load ---------------------------------------------------
def _minutes(tickets: DataFrame, name: str) -> Column:
    return C.to_number(C.first_present(tickets, name))


def tickets_overview_records(tickets: DataFrame, start, end) -> DataFrame:
    response = _minutes(tickets, "first_response_minutes")
    return within(tickets, DAY, start, end).agg(
        F.count("*").alias("total_tickets"),
        F.count_if(is_open()).alias("open_tickets"),
        F.count_if(F.col("priority") == "critical").alias("critical_tickets"),
        _pct_or_null(F.count_if("sla_breached"), F.count("*")).alias("sla_breach_pct"),
        C.rounded(F.avg("resolution_minutes") / 60.0, 1).alias("avg_resolution_hours"),
        C.rounded(F.avg(response), 0).alias("avg_first_response_min"),
    )


def daily_ticket_measures(tickets: DataFrame) -> DataFrame:
    """Per creation day: counts by urgency, breaches and the mean resolution minutes."""
    return tickets.groupBy(F.col(DAY).alias("date")).agg(
        F.count("*").alias("ticket_count"),
        F.count_if(F.col("priority") == "critical").alias("critical_count"),
        F.count_if(F.col("priority") == "high").alias("high_count"),
        F.count_if("sla_breached").alias("sla_breaches"),
        C.rounded(F.avg("resolution_minutes"), 0).alias("avg_resolution_min"),
    )


def tickets_daily_volume_records(tickets: DataFrame, start, end) -> DataFrame:
    return daily_ticket_measures(within(tickets, DAY, start, end)).orderBy("date")


def tickets_by_category_records(tickets: DataFrame, start, end) -> DataFrame:
    return within(tickets, DAY, start, end).groupBy("category").agg(
        F.count("*").alias("ticket_count"),
        _pct_or_null(F.count_if("sla_breached"), F.count("*")).alias("sla_breach_pct"),
        C.rounded(F.avg("resolution_minutes") / 60.0, 1).alias("avg_resolution_hours"),
    ).orderBy(F.desc("ticket_count"), "category")
