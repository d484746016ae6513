"""Named queries: reports over a loaded warehouse, from daily partial rows and the months of the period."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import rollups, tickets
from tidewatch.plans import facts, ingest, reports
from tidewatch.plans import feed_sql as S
from tidewatch.plans.registry import query
from tidewatch.session import work_dir
from tidewatch.sources import feeds
from tidewatch.sources.warehouse import Warehouse


def ticket_store(spark, sf_dir) -> Warehouse:
    """Tickets in two loads, the odd ones first."""
    store = Warehouse(spark, work_dir(spark, "warehouse"))
    feed = feeds.raw_tickets(spark, sf_dir)
    for k in (1, 0):
        ingest.ingest_feed(
            store, feed.filter(f"row_index % 2 = {k}"), "tickets", f"{k}.csv", facts.AS_OF, facts.AS_OF)
    return store


def hours_store(spark, sf_dir) -> Warehouse:
    """Hours in two loads, each of half of the employees."""
    store = Warehouse(spark, work_dir(spark, "warehouse"))
    feed = feeds.raw_workforce(spark, sf_dir)
    for k in (1, 0):
        half = feed.filter(f"cast(substr(employee_id, 4) as long) % 2 = {k}")
        ingest.ingest_feed(store, half, "workforce", f"{k}.csv", facts.AS_OF, facts.AS_OF)
    return store


def stored_trends(store: Warehouse, start, end):
    return rollups.ticket_trends(store.read_between("daily_ticket", start, end), start, end)


def stored_sla(store: Warehouse, start, end):
    return tickets.sla_report(store.read_between("fact_ticket", start, end), start, end)


def stored_gaps(store: Warehouse, departments, start, end):
    return rollups.staffing_gaps(store.read_between("daily_operations", start, end), departments, start, end)


def stored_summary(store: Warehouse, start, end):
    days, hours = (store.read_between(t, start, end) for t in ("daily_operations", "fact_operations"))
    return rollups.workforce_summary(days, hours, start, end)


@query("g8_ticket_trends_stored", reports.TRENDS_SQL)
def ticket_trends_stored(spark, sf_dir):
    return stored_trends(ticket_store(spark, sf_dir), reports.TICKETS_FROM, reports.TICKETS_TO)


@query("g10_sla_report_stored", reports.SLA_SQL)
def sla_report_stored(spark, sf_dir):
    return stored_sla(ticket_store(spark, sf_dir), reports.TICKETS_FROM, reports.TICKETS_TO)


@query("g5_staffing_gaps_stored", reports.gaps_sql(100))
def staffing_gaps_stored(spark, sf_dir):
    store = hours_store(spark, sf_dir)
    return stored_gaps(store, facts.departments(spark, sf_dir), reports.HOURS_FROM, reports.HOURS_TO)


@query("g1_workforce_summary_stored", reports._workforce_summary_sql(""))
def workforce_summary_stored(spark, sf_dir):
    return stored_summary(hours_store(spark, sf_dir), reports.HOURS_FROM, reports.HOURS_TO)


@query("g13_stored_days", f"""
WITH {S.HOURS}
SELECT date, department_code, count(*) AS rows, count(*) FILTER (WHERE absent) AS absences,
  round(sum(actual_hours), 6) AS actual_hours, count(utilization_rate) AS measured
FROM hours GROUP BY date, department_code""")
def stored_days(spark, sf_dir):
    """The partial rows of all loads add up to the days of the fact."""
    return hours_store(spark, sf_dir).read("daily_operations").groupBy("date", "department_code").agg(
        F.sum("rows").alias("rows"), F.sum("absences").alias("absences"),
        F.round(F.sum("actual_hours_sum"), 6).alias("actual_hours"),
        F.sum("utilization_rate_n").alias("measured"))
