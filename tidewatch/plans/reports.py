"""Named queries: reports over tickets, hours and market signals."""

from __future__ import annotations

from tidewatch.operators import market, tickets, workforce
from tidewatch.operators.periods import within
from tidewatch.plans import facts
from tidewatch.plans import feed_sql as S
from tidewatch.plans.registry import query

TICKETS_FROM, TICKETS_TO = "2024-01-05", "2024-01-28"
HOURS_FROM, HOURS_TO = "1997-03-01", "1999-08-31"
SIGNALS_FROM, SIGNALS_TO = "1998-01-01", "2000-12-31"

_T = f"created_date BETWEEN DATE '{TICKETS_FROM}' AND DATE '{TICKETS_TO}'"
_H = f"date BETWEEN DATE '{HOURS_FROM}' AND DATE '{HOURS_TO}'"
_M = f"signal_date BETWEEN DATE '{SIGNALS_FROM}' AND DATE '{SIGNALS_TO}'"
_OPEN = "status IN ('open', 'in_progress')"


# --- tickets of the file upload ---------------------------------------------------
def _ticket_summary_sql(extra: str) -> str:
    return f"""
WITH {S.TICKETS}
SELECT DATE '{TICKETS_FROM}' AS period_start, DATE '{TICKETS_TO}' AS period_end,
  count(*) AS total,
  count(*) FILTER (WHERE status = 'open') AS open,
  count(*) FILTER (WHERE status = 'in_progress') AS in_progress,
  count(*) FILTER (WHERE status = 'resolved') AS resolved,
  count(*) FILTER (WHERE status = 'closed') AS closed,
  count(*) FILTER (WHERE sla_breached) AS sla_breach_count,
  round(count(*) FILTER (WHERE sla_breached) / greatest(count(*), 1) * 100, 1)
    AS sla_breach_rate_pct,
  coalesce(round(round(avg(actual_resolution_hours), 9), 2), 0.0) AS avg_resolution_hours,
  count(*) FILTER (WHERE priority = 'critical' AND {_OPEN}) AS critical_open,
  count(*) FILTER (WHERE escalated) AS escalated_count
FROM tickets WHERE {_T} {extra}"""


@query("g7_ticket_summary", _ticket_summary_sql(""))
def ticket_summary(spark, sf_dir):
    return tickets.ticket_summary(facts.ticket_facts(spark, sf_dir), TICKETS_FROM, TICKETS_TO)


@query("g7_ticket_summary_department", _ticket_summary_sql("AND department_code = 'SUPPORT'"))
def ticket_summary_department(spark, sf_dir):
    rows = facts.ticket_facts(spark, sf_dir)
    return tickets.ticket_summary(rows, TICKETS_FROM, TICKETS_TO, department="SUPPORT")


TRENDS_SQL = f"""
WITH {S.TICKETS},
daily AS (
  SELECT created_date AS date, count(*) AS created_count,
    count(*) FILTER (WHERE status IN ('resolved', 'closed')) AS resolved_count,
    avg(sentiment_score) AS sentiment
  FROM tickets WHERE {_T} GROUP BY created_date
)
SELECT date, created_count, resolved_count, created_count - resolved_count AS net_change,
  greatest(CAST(sum(created_count - resolved_count) OVER (ORDER BY date) AS BIGINT), 0)
    AS cumulative_open,
  round(round(sentiment, 9), 2) + 0.0 AS avg_sentiment
FROM daily"""


@query("g8_ticket_trends", TRENDS_SQL)
def ticket_trends(spark, sf_dir):
    return tickets.ticket_trends(facts.ticket_facts(spark, sf_dir), TICKETS_FROM, TICKETS_TO)


@query("g9_tickets_by_category", f"""
WITH {S.TICKETS}
SELECT category, count(*) AS count,
  round(count(*) / greatest(sum(count(*)) OVER (), 1) * 100, 1) AS pct_of_total,
  coalesce(round(round(avg(actual_resolution_hours), 9), 2), 0.0) AS avg_resolution_hours,
  round(100.0 * count(*) FILTER (WHERE sla_breached) / count(*), 1) AS breach_rate_pct
FROM tickets WHERE {_T} GROUP BY category""")
def tickets_by_category(spark, sf_dir):
    return tickets.tickets_by_category(facts.ticket_facts(spark, sf_dir), TICKETS_FROM, TICKETS_TO)


SLA_SQL = f"""
WITH {S.TICKETS}
SELECT priority, sla_target_hours, count(*) AS total,
  count(*) FILTER (WHERE sla_breached) AS breached,
  round(count(*) FILTER (WHERE sla_breached) / greatest(count(*), 1) * 100, 1) AS breach_rate_pct,
  coalesce(round(round(avg(actual_resolution_hours), 9), 2), 0.0) AS avg_resolution_hours,
  coalesce(round(round(quantile_cont(actual_resolution_hours, 0.95), 9), 2), 0.0) AS p95_resolution_hours
FROM tickets WHERE {_T} GROUP BY priority, sla_target_hours"""


@query("g10_sla_report", SLA_SQL)
def sla_report(spark, sf_dir):
    return tickets.sla_report(facts.ticket_facts(spark, sf_dir), TICKETS_FROM, TICKETS_TO)


# --- hours of the file upload -------------------------------------------------------
def _workforce_summary_sql(extra: str) -> str:
    return f"""
WITH {S.HOURS},
totals AS (
  SELECT count(DISTINCT employee_id) AS total_employees,
    coalesce(round(round(sum(scheduled_hours), 9), 2), 0.0) AS total_scheduled_hours,
    coalesce(round(round(sum(actual_hours), 9), 2), 0.0) AS total_actual_hours,
    coalesce(round(round(avg(utilization_rate) * 100, 9), 1), 0.0) AS avg_utilization_pct,
    coalesce(round(round(sum(overtime_hours), 9), 2), 0.0) AS total_overtime_hours,
    count(*) FILTER (WHERE absent) AS total_absences,
    coalesce(round(round(avg(demand_units), 9), 2), 0.0) AS avg_demand,
    coalesce(round(round(avg(capacity_units), 9), 2), 0.0) AS avg_capacity
  FROM hours WHERE {_H} {extra}
)
SELECT DATE '{HOURS_FROM}' AS period_start, DATE '{HOURS_TO}' AS period_end, *,
  round(total_absences / greatest(total_employees, 1) * 100, 1) AS absence_rate_pct,
  round(avg_demand / greatest(CASE WHEN avg_capacity = 0 THEN 1 ELSE avg_capacity END, 0.01)
    * 100, 1) AS demand_coverage_pct
FROM totals"""


@query("g1_workforce_summary", _workforce_summary_sql(""))
def workforce_summary(spark, sf_dir):
    return workforce.workforce_summary(facts.hour_facts(spark, sf_dir), HOURS_FROM, HOURS_TO)


@query("g1_workforce_summary_department", _workforce_summary_sql("AND department_code = 'D2'"))
def workforce_summary_department(spark, sf_dir):
    rows = facts.hour_facts(spark, sf_dir)
    return workforce.workforce_summary(rows, HOURS_FROM, HOURS_TO, department="D2")


_BY_DEPARTMENT = f"""
per AS (
  SELECT code AS department_code, name AS department_name,
    count(DISTINCT employee_id) AS headcount,
    coalesce(round(round(sum(scheduled_hours), 9), 2), 0.0) AS scheduled_hours,
    coalesce(round(round(sum(actual_hours), 9), 2), 0.0) AS actual_hours,
    coalesce(round(round(avg(utilization_rate) * 100, 9), 1), 0.0) AS utilization_pct,
    coalesce(round(round(sum(overtime_hours), 9), 2), 0.0) AS overtime_hours,
    count(*) FILTER (WHERE absent) AS absence_count,
    coalesce(round(round(sum(demand_units), 9), 2), 0.0) AS demand_units,
    coalesce(round(round(sum(capacity_units), 9), 2), 0.0) AS capacity_units
  FROM hours JOIN departments ON department_code = code WHERE {_H} GROUP BY code, name
)"""
_STATUS = """CASE WHEN utilization_pct >= 95 THEN 'over_capacity'
    WHEN utilization_pct >= 80 THEN 'optimal' WHEN utilization_pct >= 60 THEN 'underutilized'
    ELSE 'critical_underutilization' END"""

BY_DEPARTMENT_SQL = f"""
WITH {S.HOURS}, {S.DEPARTMENTS}, {_BY_DEPARTMENT}
SELECT *, round(demand_units / greatest(capacity_units, 0.01) * 100, 1) AS demand_coverage_pct,
  {_STATUS} AS staffing_status
FROM per"""


@query("g2_workforce_by_department", BY_DEPARTMENT_SQL)
def workforce_by_department(spark, sf_dir):
    return workforce.workforce_by_department(
        facts.hour_facts(spark, sf_dir), facts.departments(spark, sf_dir), HOURS_FROM, HOURS_TO)


@query("g3_classify_status", f"""
WITH {S.HOURS},
daily AS (SELECT date, department_code, round(round(avg(utilization_rate) * 100, 9), 1) AS utilization_pct
          FROM hours GROUP BY date, department_code)
SELECT staffing_status, count(*) AS days
FROM (SELECT {_STATUS} AS staffing_status FROM daily) GROUP BY staffing_status""")
def classify_status(spark, sf_dir):
    daily = facts.hour_facts(spark, sf_dir).groupBy("date", "department_code").agg(
        workforce.utilization_avg().alias("pct"))
    return daily.groupBy(workforce.classify_status(daily["pct"]).alias("staffing_status")).count(
    ).withColumnRenamed("count", "days")


HEATMAP_SQL = f"""
WITH {S.HOURS}, {S.DEPARTMENTS}
SELECT date, code AS department_code, name AS department_name,
  coalesce(round(round(avg(utilization_rate) * 100, 9), 1), 0.0) AS utilization_pct,
  count(DISTINCT employee_id) AS headcount, count(*) FILTER (WHERE absent) AS absences
FROM hours JOIN departments ON department_code = code WHERE {_H} GROUP BY date, code, name"""


@query("g4_utilization_heatmap", HEATMAP_SQL)
def utilization_heatmap(spark, sf_dir):
    return workforce.utilization_heatmap(
        facts.hour_facts(spark, sf_dir), facts.departments(spark, sf_dir), HOURS_FROM, HOURS_TO)


def gaps_sql(limit: int) -> str:
    return f"""
WITH {S.HOURS}, {S.DEPARTMENTS},
per AS (
  SELECT date, code AS department_code, name AS department_name,
    round(sum(demand_units), 6) AS demand, round(sum(capacity_units), 6) AS capacity
  FROM hours JOIN departments ON department_code = code WHERE {_H} GROUP BY date, code, name
),
top AS (
  SELECT *, round(demand - capacity, 6) AS gap,
    greatest(CASE WHEN capacity = 0 THEN 1 ELSE capacity END, 0.01) AS divisor
  FROM per WHERE demand > round(capacity * 1.05, 6)
  ORDER BY gap DESC NULLS FIRST, date, department_code LIMIT {limit}
)
SELECT date, department_code, department_name, demand, capacity, gap,
  round(gap / divisor * 100, 1) AS gap_pct,
  CASE WHEN gap / divisor > 0.25 THEN 'critical' WHEN gap / divisor > 0.15 THEN 'warning'
    ELSE 'low' END AS severity
FROM top"""


@query("g5_staffing_gaps", gaps_sql(100))
def staffing_gaps(spark, sf_dir):
    return workforce.staffing_gaps(
        facts.hour_facts(spark, sf_dir), facts.departments(spark, sf_dir), HOURS_FROM, HOURS_TO)


@query("g6_classify_gap", f"""
WITH {S.HOURS},
per AS (SELECT round(sum(demand_units), 6) AS d, round(sum(capacity_units), 6) AS c
        FROM hours GROUP BY date, department_code)
SELECT severity, count(*) AS days FROM (
  SELECT CASE WHEN round(d - c, 6) / greatest(c, 0.01) > 0.25 THEN 'critical'
    WHEN round(d - c, 6) / greatest(c, 0.01) > 0.15 THEN 'warning' ELSE 'low' END AS severity
  FROM per) GROUP BY severity""")
def classify_gap(spark, sf_dir):
    from pyspark.sql import functions as F

    per = facts.hour_facts(spark, sf_dir).groupBy("date", "department_code").agg(
        F.round(F.sum("demand_units"), 6).alias("d"), F.round(F.sum("capacity_units"), 6).alias("c"))
    severity = workforce.classify_gap(F.round(per["d"] - per["c"], 6), per["c"])
    return per.groupBy(severity.alias("severity")).agg(F.count("*").alias("days"))


# --- market signals -------------------------------------------------------------------
def signals_sql(extra: str = "", limit: int | None = 200) -> str:
    newest = "" if limit is None else f"LIMIT {limit}"
    return f"""
SELECT signal_date, source, category, CAST(NULL AS VARCHAR) AS subcategory, region, industry,
  value, CAST(NULL AS VARCHAR) AS value_label, change_pct, CAST(NULL AS VARCHAR) AS notes
FROM signals WHERE {_M} {extra}
ORDER BY signal_date DESC, row_index {newest}"""


def signals_of_period(spark, sf_dir):
    """All signals of the period; the listing g12 alone stops at the newest."""
    return within(facts.signal_facts(spark, sf_dir), "signal_date", SIGNALS_FROM, SIGNALS_TO)


@query("g12_market_signals", f"WITH {S.SIGNALS} {signals_sql()}")
def market_signals(spark, sf_dir):
    return market.market_signals(facts.signal_facts(spark, sf_dir), SIGNALS_FROM, SIGNALS_TO)


_COMPETITOR_SQL = signals_sql("AND category = 'competitor'")


@query("g12_market_signals_category", f"WITH {S.SIGNALS} {_COMPETITOR_SQL}")
def market_signals_category(spark, sf_dir):
    rows = facts.signal_facts(spark, sf_dir)
    return market.market_signals(rows, SIGNALS_FROM, SIGNALS_TO, category="competitor")


# --- hours of the record load -----------------------------------------------------------
_RECORD_MEASURES = """count(DISTINCT employee_code) AS headcount,
    round(round(avg(utilization_pct), 9), 1) AS avg_utilization_pct,
    round(round(sum(overtime_hours), 9), 1) AS total_overtime_hours,
    round(100.0 * count(*) FILTER (WHERE is_absent) / nullif(count(*), 0), 1) AS absence_rate_pct,
    CAST(sum(tasks_completed) AS BIGINT) AS total_tasks,
    round(round(avg(actual_hours), 9), 2) AS avg_actual_hours"""


@query("g13_workforce_overview", f"""
WITH {S.hour_records()},
cur AS (SELECT {_RECORD_MEASURES} FROM hour_records WHERE {_H}),
prev AS (SELECT count(DISTINCT employee_code) AS headcount, round(round(avg(utilization_pct), 9), 1) AS util
  FROM hour_records WHERE date BETWEEN
    DATE '{HOURS_FROM}' - CAST(DATE '{HOURS_TO}' - DATE '{HOURS_FROM}' AS INTEGER)
    AND DATE '{HOURS_FROM}' - 1)
SELECT cur.*, cur.headcount - prev.headcount AS headcount_change,
  CASE WHEN avg_utilization_pct <> 0 AND util <> 0 THEN round(avg_utilization_pct - util, 1) + 0.0
    END AS utilization_change_pct
FROM cur, prev""")
def workforce_overview(spark, sf_dir):
    rows = facts.hour_records(spark, sf_dir)
    return workforce.workforce_overview_records(rows, HOURS_FROM, HOURS_TO)


@query("g14_workforce_daily_utilization", f"""
WITH {S.hour_records()}
SELECT date, count(DISTINCT employee_code) AS headcount,
  round(round(avg(utilization_pct), 9), 1) AS avg_utilization_pct,
  round(sum(overtime_hours), 6) AS overtime_hours,
  count(*) FILTER (WHERE is_absent) AS absent_count
FROM hour_records WHERE {_H} GROUP BY date""")
def workforce_daily(spark, sf_dir):
    rows = facts.hour_records(spark, sf_dir)
    return workforce.workforce_daily_records(rows, HOURS_FROM, HOURS_TO)


@query("g15_workforce_by_department_records", f"""
WITH {S.hour_records()}, {S.DEPARTMENTS}
SELECT name AS department, count(DISTINCT employee_code) AS headcount,
  round(round(avg(utilization_pct), 9), 1) AS avg_utilization_pct,
  CAST(sum(tasks_completed) AS BIGINT) AS total_tasks,
  round(100.0 * count(*) FILTER (WHERE is_absent) / nullif(count(*), 0), 1) AS absence_rate_pct
FROM hour_records JOIN departments ON department_code = code WHERE {_H} GROUP BY name""")
def workforce_by_department_records(spark, sf_dir):
    return workforce.workforce_by_department_records(
        facts.hour_records(spark, sf_dir), facts.departments(spark, sf_dir), HOURS_FROM, HOURS_TO)


# --- tickets of the record load -----------------------------------------------------------
_BREACH_PCT = "round(100.0 * count(*) FILTER (WHERE sla_breached) / nullif(count(*), 0), 1)"


@query("g16_tickets_overview", f"""
WITH {S.TICKET_RECORDS}
SELECT count(*) AS total_tickets, count(*) FILTER (WHERE {_OPEN}) AS open_tickets,
  count(*) FILTER (WHERE priority = 'critical') AS critical_tickets,
  {_BREACH_PCT} AS sla_breach_pct,
  round(round(avg(resolution_minutes) / 60.0, 9), 1) AS avg_resolution_hours,
  round(round(avg(CAST(first_response_minutes AS DOUBLE)), 9), 0) AS avg_first_response_min
FROM ticket_records WHERE {_T}""")
def tickets_overview(spark, sf_dir):
    rows = facts.ticket_records(spark, sf_dir)
    return tickets.tickets_overview_records(rows, TICKETS_FROM, TICKETS_TO)


@query("g17_tickets_daily_volume", f"""
WITH {S.TICKET_RECORDS}
SELECT created_date AS date, count(*) AS ticket_count,
  count(*) FILTER (WHERE priority = 'critical') AS critical_count,
  count(*) FILTER (WHERE priority = 'high') AS high_count,
  count(*) FILTER (WHERE sla_breached) AS sla_breaches,
  round(round(avg(resolution_minutes), 9), 0) AS avg_resolution_min
FROM ticket_records WHERE {_T} GROUP BY created_date""")
def tickets_daily_volume(spark, sf_dir):
    rows = facts.ticket_records(spark, sf_dir)
    return tickets.tickets_daily_volume_records(rows, TICKETS_FROM, TICKETS_TO)


@query("g18_tickets_by_category_records", f"""
WITH {S.TICKET_RECORDS}
SELECT category, count(*) AS ticket_count, {_BREACH_PCT} AS sla_breach_pct,
  round(round(avg(resolution_minutes) / 60.0, 9), 1) AS avg_resolution_hours
FROM ticket_records WHERE {_T} GROUP BY category""")
def tickets_by_category_records(spark, sf_dir):
    rows = facts.ticket_records(spark, sf_dir)
    return tickets.tickets_by_category_records(rows, TICKETS_FROM, TICKETS_TO)
