"""Named queries: period measures, narratives, insight cards and dashboard shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.operators import anomaly, dashboard, forecast, market, narrative, tickets, workforce
from tidewatch.plans import facts, reports
from tidewatch.plans import feed_sql as S
from tidewatch.plans import series_queries as Q
from tidewatch.plans.facts import SHIFT_DAYS
from tidewatch.plans.registry import query

START, END = "2024-01-16", "2024-01-30"
DEPT = ["department_code"]
_SENTENCES = "; "


def f1(expr: str, places: int = 1) -> str:
    """Text of a number with fixed places, without a negative zero."""
    return f"printf('%.{places}f', round({expr}, {places}) + 0.0)"


def _kpis(spark, sf_dir, by=()):
    return narrative.period_kpis(
        facts.hour_facts(spark, sf_dir, SHIFT_DAYS), facts.ticket_facts(spark, sf_dir), START, END,
        by=by)


def _kpi_sql(by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON TRUE"
    return f"""{S.hours(SHIFT_DAYS)}, {S.TICKETS},
wf AS (SELECT {key}count(DISTINCT employee_id) AS headcount, avg(utilization_rate) * 100 AS util,
  count(*) FILTER (WHERE absent) AS absences, sum(overtime_hours) AS ot,
  CASE WHEN avg(capacity_units) > 0 THEN avg(demand_units) / avg(capacity_units) * 100 END AS cover
  FROM hours WHERE date BETWEEN DATE '{START}' AND DATE '{END}' {group}),
cur AS (SELECT {key}count(*) AS n, count(*) FILTER (WHERE status IN ('open', 'in_progress')) AS opened,
  count(*) FILTER (WHERE sla_breached) AS breaches, avg(actual_resolution_hours) AS hours,
  avg(sentiment_score) AS mood
  FROM tickets WHERE created_date BETWEEN DATE '{START}' AND DATE '{END}' {group}),
prev AS (SELECT {key}count(*) AS n0 FROM tickets
  WHERE created_date BETWEEN DATE '{START}' - 15 AND DATE '{START}' - 1 {group}),
kpis AS (SELECT {key}coalesce(headcount, 0) AS headcount,
  round(coalesce(util, 0.0), 9) AS utilization, coalesce(absences, 0) AS absences,
  round(coalesce(ot, 0.0), 6) AS overtime, round(coalesce(cover, 0.0), 9) AS demand_coverage,
  coalesce(n, 0) AS tickets, coalesce(opened, 0) AS open_tickets, coalesce(breaches, 0) AS breaches,
  round(coalesce(hours, 0.0), 9) AS avg_resolution, mood AS avg_sentiment,
  coalesce(n0, 0) AS prior_tickets,
  CASE WHEN n0 > 0 THEN (coalesce(n, 0) - n0) / n0 * 100 ELSE 0.0 END AS ticket_change_pct,
  CASE WHEN n > 0 THEN breaches / n * 100 ELSE 0.0 END AS breach_rate
  FROM wf FULL JOIN cur {join} FULL JOIN prev {join})"""


_KPI_COLUMNS = ["headcount", "absences", "tickets", "open_tickets", "breaches", "prior_tickets"]
_KPI_ROUNDED = ["utilization", "overtime", "demand_coverage", "avg_resolution", "avg_sentiment",
                "ticket_change_pct", "breach_rate"]


def _register_kpis(name: str, by: list[str]):
    key = ", ".join(by)

    @query(name, f"""
WITH {_kpi_sql(key)}
SELECT {key + ', ' if by else ''}{', '.join(_KPI_COLUMNS)},
  {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _KPI_ROUNDED)} FROM kpis""")
    def kpis(spark, sf_dir):
        return _kpis(spark, sf_dir, by).select(
            *by, *_KPI_COLUMNS, *[F.round(c, 6).alias(c) for c in _KPI_ROUNDED])


_register_kpis("m1_period_kpis", [])
_register_kpis("m1_period_kpis_by_department", DEPT)


_FINDINGS = f"""list_filter([
  'Workforce utilization averaged ' || {f1('utilization')} || '% over the period (' || headcount
    || ' active employees tracked).',
  CASE WHEN ticket_change_pct < -10 THEN 'Support demand decreased ' || {f1('abs(ticket_change_pct)', 0)}
    || '% period-over-period.' END,
  CASE WHEN breach_rate > 0 AND breach_rate <= 20 THEN 'SLA compliance at '
    || {f1('100 - breach_rate')} || '%.' END,
  CASE WHEN utilization < 60 THEN 'Utilization at ' || {f1('utilization')}
    || '% suggests available capacity — review scheduling efficiency.' END,
  CASE WHEN overtime > 100 THEN 'Overtime hours totalled ' || {f1('overtime', 0)}
    || 'h — monitor for burnout signals.' END], lambda x: x IS NOT NULL)"""
_ALERTS = f"""list_filter([
  CASE WHEN ticket_change_pct > 10 THEN 'Support demand rose ' || {f1('ticket_change_pct', 0)}
    || '% period-over-period (' || tickets || ' tickets vs ' || prior_tickets || ' prior).' END,
  CASE WHEN breach_rate > 20 THEN 'SLA breach rate reached ' || {f1('breach_rate')}
    || '% — exceeds the 20% warning threshold.' END,
  CASE WHEN utilization > 95 THEN 'Workforce is operating at ' || {f1('utilization')}
    || '% utilization — over-capacity risk.' END,
  CASE WHEN demand_coverage > 100 THEN 'Demand (' || {f1('demand_coverage', 0)}
    || '% of capacity) is outpacing available staff headcount.' END], lambda x: x IS NOT NULL)"""
_ADVICE = """list_filter([
  CASE WHEN ticket_change_pct > 10
    THEN 'Review staffing allocation to handle elevated support volume.' END,
  CASE WHEN breach_rate > 20 THEN 'Audit high-priority ticket queues and escalation paths.' END,
  CASE WHEN utilization > 95
    THEN 'Consider temporary staffing augmentation or workload redistribution.' END],
  lambda x: x IS NOT NULL)"""
_HEADLINE = """CASE
  WHEN breach_rate > 25 AND ticket_change_pct > 15
    THEN 'High demand surge with SLA risk — immediate attention recommended'
  WHEN breach_rate > 25 THEN 'SLA performance below target — review ticket resolution capacity'
  WHEN ticket_change_pct > 15
    THEN 'Support volume trending up significantly — staffing alignment needed'
  WHEN utilization > 95 THEN 'Workforce at near-maximum capacity — monitor for quality degradation'
  WHEN utilization < 60 THEN 'Operational capacity is under-utilized — scheduling review recommended'
  ELSE 'Operations within normal parameters — minor optimizations available' END"""
_PERIOD = "'Jan 16 – Jan 30, 2024'"
_SUMMARY = f"""'For the period ' || {_PERIOD} || ', the organization tracked ' || headcount
  || ' employees at ' || {f1('utilization')} || '% utilization with ' || tickets
  || ' support tickets raised (' || open_tickets || ' still open). Average ticket resolution time was '
  || {f1('avg_resolution')} || ' hours with a ' || {f1('breach_rate')} || '% SLA breach rate.'"""


def _listed(narration, *names):
    return [F.array_join(n, _SENTENCES).alias(n) for n in names]


def _text(items: str, limit: int | None = None) -> str:
    return f"array_to_string(({items}){f'[:{limit}]' if limit else ''}, '{_SENTENCES}')"


@query("m2_findings_alerts_recommendations", f"""
WITH {_kpi_sql('department_code')}
SELECT department_code, {_text(_FINDINGS)} AS key_findings, {_text(_ALERTS)} AS alerts,
  {_text(_ADVICE)} AS recommendations FROM kpis""")
def findings(spark, sf_dir):
    told = narrative.narrative(_kpis(spark, sf_dir, DEPT), by=DEPT)
    return told.select(*DEPT, *_listed(told, "key_findings", "alerts", "recommendations"))


@query("m3_headline", f"WITH {_kpi_sql('department_code')} SELECT department_code, {_HEADLINE} AS headline FROM kpis")
def headline(spark, sf_dir):
    return narrative.narrative(_kpis(spark, sf_dir, DEPT), by=DEPT).select(*DEPT, "headline")


@query("m4_role_filter", f"""
WITH {_kpi_sql()}
SELECT 'executive' AS role_level, {_text(_FINDINGS, 3)} AS key_findings, {_text(_ALERTS, 2)} AS alerts,
  {_text(_ADVICE, 2)} AS recommendations FROM kpis""")
def role_filter(spark, sf_dir):
    told = narrative.narrative(_kpis(spark, sf_dir), "executive")
    return told.select("role_level", *_listed(told, "key_findings", "alerts", "recommendations"))


@query("m5_summary_text", f"WITH {_kpi_sql()} SELECT {_PERIOD} AS period, {_SUMMARY} AS summary FROM kpis")
def summary_text(spark, sf_dir):
    return narrative.narrative(_kpis(spark, sf_dir)).select("period", "summary")


def _weekly(spark, sf_dir, by=()):
    hours = C.with_default(
        facts.hour_records(spark, sf_dir, SHIFT_DAYS), "department_code", V.DEFAULT_DEPARTMENT)
    return narrative.weekly_kpis(hours, facts.ticket_records(spark, sf_dir), END, by=by)


def _weekly_sql(by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON TRUE"
    cur = f"BETWEEN DATE '{END}' - 7 AND DATE '{END}'"
    prev = f"BETWEEN DATE '{END}' - 14 AND DATE '{END}' - 8"
    return f"""{S.hour_records(SHIFT_DAYS).replace('hour_records AS', 'known_records AS')},
hour_records AS (SELECT * REPLACE (coalesce(department_code, 'UNKNOWN') AS department_code)
  FROM known_records), {S.TICKET_RECORDS},
w1 AS (SELECT {key}round(round(avg(utilization_pct), 9), 1) AS avg_utilization_pct,
  round(100.0 * count(*) FILTER (WHERE is_absent) / nullif(count(*), 0), 1) AS absence_rate_pct,
  count(DISTINCT employee_code) AS headcount FROM hour_records WHERE date {cur} {group}),
w0 AS (SELECT {key}count(DISTINCT employee_code) AS prev_headcount FROM hour_records
  WHERE date {prev} {group}),
t1 AS (SELECT {key}count(*) AS total_tickets_this_week,
  round(100.0 * count(*) FILTER (WHERE sla_breached) / nullif(count(*), 0), 1) AS sla_breach_pct,
  round(round(avg(resolution_minutes) / 60.0, 9), 1) AS avg_resolution_hours
  FROM ticket_records WHERE created_date {cur} {group}),
t0 AS (SELECT {key}count(*) AS prev_tickets FROM ticket_records WHERE created_date {prev} {group}),
kpis AS (SELECT *, round((headcount - prev_headcount)
    / CASE WHEN prev_headcount > 0 THEN prev_headcount END * 100, 1) + 0.0 AS staffing_change_pct,
  round((total_tickets_this_week - prev_tickets)
    / CASE WHEN prev_tickets > 0 THEN prev_tickets END * 100, 1) + 0.0 AS volume_change_pct
  FROM (SELECT {key}avg_utilization_pct, absence_rate_pct, coalesce(headcount, 0) AS headcount,
      coalesce(prev_headcount, 0) AS prev_headcount,
      coalesce(total_tickets_this_week, 0) AS total_tickets_this_week, sla_breach_pct,
      avg_resolution_hours, coalesce(prev_tickets, 0) AS prev_tickets
    FROM w1 FULL JOIN w0 {join} FULL JOIN t1 {join} FULL JOIN t0 {join}))"""


_WEEKLY = ["avg_utilization_pct", "absence_rate_pct", "headcount", "prev_headcount",
           "total_tickets_this_week", "sla_breach_pct", "avg_resolution_hours", "prev_tickets",
           "staffing_change_pct", "volume_change_pct"]


def _register_weekly(name: str, by: list[str]):
    @query(name, f"""
WITH {_weekly_sql(', '.join(by))}
SELECT {', '.join([*by, *_WEEKLY])}, volume_change_pct AS demand_change_pct FROM kpis""")
    def weekly(spark, sf_dir):
        return _weekly(spark, sf_dir, by).select(*by, *_WEEKLY, "demand_change_pct")


_register_weekly("g19_weekly_kpis", [])
_register_weekly("g19_weekly_kpis_by_department", DEPT)


def _cards(rules: list[tuple[str, str, str, str, str, str, str]]) -> str:
    """(condition, title, body, severity, metric_key, value, change) -> list of structs."""
    return "list_filter([" + ", ".join(
        f"CASE WHEN {cond} THEN {{title: '{title}', body: {body}, severity: '{sev}', "
        f"metric_key: '{key}', value: {value}::DOUBLE, change_pct: {change}::DOUBLE}} END"
        for cond, title, body, sev, key, value, change in rules) + "], lambda x: x IS NOT NULL)"


_GAP = "(volume_change_pct - staffing_change_pct)"
_WF_CARDS = _cards([
    (f"{_GAP} > 10", "Staffing Gap Widening",
     f"'Demand rose ' || {f1('volume_change_pct')} || '% week-over-week while staffing rose only ' || "
     f"{f1('staffing_change_pct')} || '%. A ' || {f1(_GAP)} || "
     "'pp gap may strain capacity and increase SLA risk.'", "alert", "staffing_gap", "NULL", _GAP),
    (f"{_GAP} < -10", "Over-Staffing Signal",
     f"'Staffing grew ' || {f1('staffing_change_pct')} || '% while demand grew only ' || "
     f"{f1('volume_change_pct')} || '%. Consider reviewing shift allocations.'",
     "warning", "staffing_overage", "NULL", _GAP),
    ("avg_utilization_pct < 60", "Low Workforce Utilization",
     f"'Average utilization is ' || {f1('avg_utilization_pct')} || "
     "'% — below the 75% operational target.'", "warning", "utilization", "avg_utilization_pct", "NULL"),
    ("avg_utilization_pct > 95", "Near-Capacity Utilization",
     f"'Average utilization at ' || {f1('avg_utilization_pct')} || "
     "'%. Risk of burnout and quality degradation.'", "alert", "utilization",
     "avg_utilization_pct", "NULL"),
    ("avg_utilization_pct BETWEEN 60 AND 95", "Utilization On Target",
     f"'Workforce utilization is ' || {f1('avg_utilization_pct')} || "
     "'% — within healthy operating range.'", "info", "utilization", "avg_utilization_pct", "NULL"),
    ("absence_rate_pct > 10", "Elevated Absence Rate",
     f"'Absence rate is ' || {f1('absence_rate_pct')} || "
     "'% — above the 8% benchmark. Review coverage plans.'", "warning", "absence_rate",
     "absence_rate_pct", "NULL"),
])
_TK_CARDS = _cards([
    ("volume_change_pct > 20", "Ticket Volume Spike",
     f"'Support demand rose ' || {f1('volume_change_pct')} || "
     "'% week-over-week. Investigate root cause.'", "alert", "ticket_volume", "NULL",
     "volume_change_pct"),
    ("volume_change_pct < -15", "Ticket Volume Declining",
     f"'Ticket volume dropped ' || {f1('abs(volume_change_pct)')} || '% week-over-week.'",
     "info", "ticket_volume", "NULL", "volume_change_pct"),
    ("sla_breach_pct > 15", "SLA Compliance At Risk",
     f"{f1('sla_breach_pct')} || '% of tickets breached SLA targets. "
     "Review critical and high priority response times.'", "alert", "sla_breach",
     "sla_breach_pct", "NULL"),
    ("avg_resolution_hours > 48", "Slow Resolution Times",
     f"'Average resolution time is ' || {f1('avg_resolution_hours')} || "
     "' hours. Consider triaging backlog.'", "warning", "resolution_time",
     "avg_resolution_hours", "NULL"),
])
_CARD_SQL = """c.title AS title, c.body AS body, c.severity AS severity, c.metric_key AS metric_key,
  c.value AS value, round(c.change_pct, 6) AS change_pct"""
_CARD_COLUMNS = ["title", "body", "severity", "metric_key", "value"]


def _card_columns():
    return [*_CARD_COLUMNS, F.round("change_pct", 6).alias("change_pct")]


@query("m6_workforce_insights", f"""
WITH {_weekly_sql('department_code')}
SELECT department_code, {_CARD_SQL} FROM (SELECT department_code, unnest({_WF_CARDS}) AS c FROM kpis)""")
def workforce_insights(spark, sf_dir):
    return narrative.workforce_insights(_weekly(spark, sf_dir, DEPT), DEPT).select(
        *DEPT, *_card_columns())


@query("m7_ticket_insights", f"""
WITH {_weekly_sql('department_code')}
SELECT department_code, {_CARD_SQL} FROM (SELECT department_code, unnest({_TK_CARDS}) AS c FROM kpis)""")
def ticket_insights(spark, sf_dir):
    return narrative.ticket_insights(_weekly(spark, sf_dir, DEPT), DEPT).select(
        *DEPT, *_card_columns())


@query("m8_executive_summary", f"""
WITH {_weekly_sql()}
SELECT concat_ws(chr(10), '**Operations Summary**' || chr(10),
  CASE WHEN avg_utilization_pct <> 0
    THEN '- Workforce utilization: **' || {f1('avg_utilization_pct')} || '%**' END,
  CASE WHEN total_tickets_this_week <> 0
    THEN '- Ticket volume this week: **' || total_tickets_this_week || '**'
      || CASE WHEN coalesce(volume_change_pct, 0) <> 0 THEN ' ('
        || CASE WHEN volume_change_pct >= 0 THEN '+' ELSE '' END || {f1('volume_change_pct')}
        || '% WoW)' ELSE '' END END,
  CASE WHEN sla_breach_pct IS NOT NULL
    THEN '- SLA compliance: **' || {f1('100 - sla_breach_pct')} || '%**' END,
  '- Active anomalies flagged: **3** — review recommended') AS summary
FROM kpis""")
def executive_summary(spark, sf_dir):
    return narrative.executive_summary(_weekly(spark, sf_dir), F.lit(3))


@query("m9_top_alerts", f"""
WITH {_weekly_sql('department_code')},
a AS (SELECT department_code, list_filter(list_concat({_WF_CARDS}, {_TK_CARDS}),
  lambda x: x.severity = 'alert')[:5] AS cards FROM kpis)
SELECT department_code, {_CARD_SQL} FROM (SELECT department_code, unnest(cards) AS c FROM a)""")
def top_alerts(spark, sf_dir):
    return narrative.top_alerts(_weekly(spark, sf_dir, DEPT), by=DEPT).select(
        *DEPT, *_card_columns())


# --- sorted lists, pages and unions -----------------------------------------------------------
@query("i1_top_workers", f"""
WITH {S.HOURS}, per AS (SELECT employee_id, round(sum(actual_hours), 6) AS worked
  FROM hours GROUP BY employee_id)
SELECT * FROM per ORDER BY worked DESC, employee_id LIMIT 10""")
def top_workers(spark, sf_dir):
    per = facts.hour_facts(spark, sf_dir).groupBy("employee_id").agg(
        F.round(F.sum("actual_hours"), 6).alias("worked"))
    return per.orderBy(F.desc("worked"), "employee_id").limit(10)


@query("i2_priority_order", f"""
WITH {S.TICKETS}, p AS (SELECT priority, count(*) AS n FROM tickets GROUP BY priority)
SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 2
  WHEN 'medium' THEN 3 ELSE 4 END) AS place FROM p""")
def priority_order(spark, sf_dir):
    per = facts.ticket_facts(spark, sf_dir).groupBy("priority").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(dashboard.priority_rank(F.col("priority"))))
    return dashboard.by_priority(per).withColumn("place", place)


_IQR_FOUND = f"""{Q._IQR}, found AS (SELECT department_code, ds AS date, metric,
  CASE WHEN z < 3.5 THEN 'medium' ELSE 'high' END AS severity, y AS observed_value,
  median AS expected_value FROM q)"""


@query("i3_severity_sort", f"""{_IQR_FOUND}
SELECT severity, metric, department_code, date FROM found
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END,
  metric, department_code, date""")
def severity_sort(spark, sf_dir):
    found = anomaly.iqr_anomalies(Q._every_series(spark, sf_dir), F.col("metric"), by=Q.BY)
    return dashboard.by_severity(found, "metric", "department_code", "date").select(
        "severity", "metric", "department_code", "date")


@query("i5_score_sort", f"""
WITH {S.hour_records()}, {Q._HOUR_DAYS}, {Q._labels('utilization_pct')}
SELECT date, round(-z, 4) AS anomaly_score FROM flagged ORDER BY round(-z, 4), date""")
def score_sort(spark, sf_dir):
    found = anomaly.multivariate_anomalies(
        Q.hour_days(spark, sf_dir), "utilization_pct", "workforce", Q.HOUR_FEATURES, method="zscore")
    return found.orderBy("anomaly_score", "date").select("date", "anomaly_score")


@query("i4_list_truncation", f"""
WITH {_weekly_sql('department_code')}
SELECT department_code, array_to_string(list_transform(
  (list_concat({_WF_CARDS}, {_TK_CARDS}))[:2], lambda x: x.title), '; ') AS titles FROM kpis""")
def list_truncation(spark, sf_dir):
    cards = F.concat(narrative.workforce_cards(), narrative.ticket_cards())
    return _weekly(spark, sf_dir, DEPT).select(
        *DEPT, F.array_join(F.transform(F.slice(cards, 1, 2), lambda c: c["title"]), "; ").alias("titles"))


@query("i6_page", f"""
WITH {S.TICKETS}
SELECT ticket_id, created_date, priority FROM tickets ORDER BY created_at, ticket_id LIMIT 25 OFFSET 50""")
def page(spark, sf_dir):
    rows = facts.ticket_facts(spark, sf_dir)
    return dashboard.page(rows, ["created_at", "ticket_id"], 3, 25).select(
        "ticket_id", "created_date", "priority")


@query("i6_page_count", f"""
WITH {S.TICKETS} SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM tickets""")
def page_count(spark, sf_dir):
    return dashboard.page_count(facts.ticket_facts(spark, sf_dir), 25)


@query("j1_history_and_horizon", f"""
WITH {Q._LINEAR}
SELECT is_actual, count(*) AS points, min(ds) AS first_day, max(ds) AS last_day FROM (
  SELECT TRUE AS is_actual, ds FROM i WHERE back <= 60
  UNION ALL SELECT FALSE, last_ds + (h + 1)::INTEGER FROM ahead) GROUP BY is_actual""")
def history_and_horizon(spark, sf_dir):
    return Q.build_points(spark, sf_dir).groupBy("is_actual").agg(
        F.count("*").alias("points"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"))


@query("j2_all_insights", f"""
WITH {_weekly_sql()}
SELECT source, {_CARD_SQL} FROM (
  SELECT 'workforce' AS source, unnest({_WF_CARDS}) AS c FROM kpis
  UNION ALL SELECT 'tickets', unnest({_TK_CARDS}) FROM kpis)""")
def all_insights(spark, sf_dir):
    kpis = _weekly(spark, sf_dir)
    both = narrative.workforce_insights(kpis).unionByName(narrative.ticket_insights(kpis))
    return both.select("source", *_card_columns())


@query("j3_distinct_days_and_departments", f"""
WITH {S.HOURS} SELECT count(DISTINCT date) AS days, count(DISTINCT department_code) AS departments
FROM hours""")
def distinct_days(spark, sf_dir):
    pairs = facts.hour_facts(spark, sf_dir).select("date", "department_code").distinct()
    return pairs.agg(F.count_distinct("date").alias("days"),
                     F.count_distinct("department_code").alias("departments"))


# --- dashboard shapes ---------------------------------------------------------------------------
@query("k1_heatmap_matrix", f"""
WITH {S.HOURS}, {S.DEPARTMENTS}, m AS (
  SELECT date, code AS department_code, round(round(avg(utilization_rate) * 100, 9), 1) AS u
  FROM hours JOIN departments ON department_code = code WHERE {reports._H} GROUP BY date, code),
d AS (SELECT date, row_number() OVER (ORDER BY date) AS slot FROM
  (SELECT DISTINCT date FROM m ORDER BY date DESC LIMIT 14))
SELECT department_code, {', '.join(
    f"coalesce(max(u) FILTER (WHERE slot = {i}), 0.0) AS day_{i:02d}" for i in range(1, 15))}
FROM m LEFT JOIN d USING (date) GROUP BY department_code""")
def heatmap_matrix(spark, sf_dir):
    return dashboard.heatmap_matrix(reports.utilization_heatmap(spark, sf_dir))


@query("k2_change_by_industry", f"""
WITH {S.SIGNALS}, feed AS ({reports.signals_sql(limit=None)})
SELECT industry, round(round(avg(change_pct), 9), 2) + 0.0 AS avg_change FROM feed
WHERE industry IS NOT NULL GROUP BY industry""")
def change_by_industry(spark, sf_dir):
    return market.change_by_industry(reports.signals_of_period(spark, sf_dir))


@query("k3_signals_by_category", f"""
WITH {S.SIGNALS}, feed AS ({reports.signals_sql(limit=None)})
SELECT category, count(*) AS signal_count, count(DISTINCT source) AS sources FROM feed
GROUP BY category""")
def signals_by_category(spark, sf_dir):
    grouped = market.signals_by_category(reports.signals_of_period(spark, sf_dir))
    return grouped.select("category", "signal_count", "sources")


@query("k4_utilization_band", f"""
WITH {S.HOURS}, {S.DEPARTMENTS}, m AS (
  SELECT round(round(avg(utilization_rate) * 100, 9), 1) AS u
  FROM hours JOIN departments ON department_code = code WHERE {reports._H} GROUP BY date, code)
SELECT CASE WHEN u >= 95 THEN 'red' WHEN u >= 80 THEN 'green' WHEN u >= 60 THEN 'amber' ELSE 'red' END
  AS band, count(*) AS cells FROM m GROUP BY ALL""")
def utilization_band(spark, sf_dir):
    cells = reports.utilization_heatmap(spark, sf_dir)
    return cells.groupBy(dashboard.utilization_band(F.col("utilization_pct")).alias("band")).agg(
        F.count("*").alias("cells"))


@query("k5_split_forecast", f"""
WITH {S.TICKETS}, {Q._VOLUME}, e AS (SELECT department_code, max(ds) AS last, count(*) AS n
  FROM volume GROUP BY department_code)
SELECT department_code, last + 1 AS split_date, n AS actual_points, {Q.HORIZON} AS forecast_points FROM e""")
def split_forecast(spark, sf_dir):
    points = forecast.ridge_forecast(Q.volume(spark, sf_dir), DEPT, Q.HORIZON)
    return dashboard.split_forecast(points, DEPT).groupBy(*DEPT, "split_date").agg(
        F.count("actual").alias("actual_points"), F.count("forecast").alias("forecast_points"))


@query("k6_deviation", f"""{_IQR_FOUND}
SELECT metric, department_code, date, round(observed_value - expected_value, 6) + 0.0 AS deviation
FROM found""")
def deviation(spark, sf_dir):
    found = anomaly.iqr_anomalies(Q._every_series(spark, sf_dir), F.col("metric"), by=Q.BY)
    return dashboard.with_deviation(found).select(
        "metric", "department_code", "date", F.round("deviation", 6).alias("deviation"))


@query("k7_sla_compliance", f"""
WITH {S.TICKETS}
SELECT priority, round(100 - round(count(*) FILTER (WHERE sla_breached) / count(*) * 100, 1), 1)
  AS sla_compliance_pct FROM tickets WHERE {reports._T} GROUP BY priority""")
def sla_compliance(spark, sf_dir):
    report = tickets.sla_report(
        facts.ticket_facts(spark, sf_dir), reports.TICKETS_FROM, reports.TICKETS_TO)
    pct = dashboard.sla_compliance(F.col("breach_rate_pct"))
    return report.select("priority", F.round(pct, 1).alias("sla_compliance_pct"))


@query("k8_top_departments", f"""
SELECT * FROM ({reports.BY_DEPARTMENT_SQL}) ORDER BY utilization_pct DESC, department_code LIMIT 6""")
def top_departments(spark, sf_dir):
    return reports.workforce_by_department(spark, sf_dir).limit(6)


@query("k8_top_gaps", reports.gaps_sql(15))
def top_gaps(spark, sf_dir):
    return workforce.staffing_gaps(
        facts.hour_facts(spark, sf_dir), facts.departments(spark, sf_dir),
        reports.HOURS_FROM, reports.HOURS_TO, limit=15)


@query("k8_top_signals", f"WITH {S.SIGNALS} {reports.signals_sql(limit=30)}")
def top_signals(spark, sf_dir):
    rows = facts.signal_facts(spark, sf_dir)
    return market.market_signals(rows, reports.SIGNALS_FROM, reports.SIGNALS_TO, limit=30)


@query("k9_workforce_flags", f"""
SELECT avg_utilization_pct, total_overtime_hours, avg_utilization_pct > 90 AS utilization_alert,
  total_overtime_hours > 200 AS overtime_alert FROM ({reports._workforce_summary_sql('')})""")
def workforce_flags(spark, sf_dir):
    return dashboard.workforce_flags(reports.workforce_summary(spark, sf_dir)).select(
        "avg_utilization_pct", "total_overtime_hours", "utilization_alert", "overtime_alert")


@query("k9_ticket_flags", f"""
SELECT sla_breach_rate_pct, critical_open, sla_breach_rate_pct > 20 AS breach_alert,
  critical_open > 0 AS critical_alert, round(100 - sla_breach_rate_pct, 1) AS sla_compliance_pct
FROM ({reports._ticket_summary_sql('')})""")
def ticket_flags(spark, sf_dir):
    return dashboard.ticket_flags(reports.ticket_summary(spark, sf_dir)).select(
        "sla_breach_rate_pct", "critical_open", "breach_alert", "critical_alert", "sla_compliance_pct")
