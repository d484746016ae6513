"""Named queries: daily series, windows, anomalies and forecasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions.timeparts import FEATURES
from tidewatch.operators import anomaly, forecast, smoothing, tickets, workforce
from tidewatch.operators import series as W
from tidewatch.plans import facts
from tidewatch.plans import feed_sql as S
from tidewatch.plans.registry import query

FROM, TO = "1995-01-01", "2001-12-31"
T_FROM, T_TO = "2024-01-01", "2024-01-31"
DEPT = ["department_code"]
HORIZON = 30


def _r(expr: str, places: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {places}) + 0.0"


def r(column, places: int = 6):
    return F.round(column, places)


# --- series -------------------------------------------------------------------------------
_VOLUME = """
volume AS (SELECT department_code, created_date AS ds, count(*)::DOUBLE AS y
  FROM tickets GROUP BY ALL)"""
_MEASURES = {"demand_units": "sum(demand_units)", "utilization_rate": "avg(utilization_rate) * 100",
             "absent": "count(*) FILTER (WHERE absent)::DOUBLE"}
_ALL = f"""{S.HOURS}, {S.TICKETS}, {_VOLUME}, s AS (
  SELECT 'ticket_volume' AS metric, * FROM volume """ + " ".join(
    f"UNION ALL SELECT '{m}', department_code, date, round({e}, 9) FROM hours GROUP BY ALL"
    for m, e in _MEASURES.items()) + ")"


def volume(spark, sf_dir, by=DEPT):
    return W.metric_series(None, facts.ticket_facts(spark, sf_dir), "ticket_volume", T_FROM, T_TO, by=by)


def demand(spark, sf_dir, by=DEPT, metric="demand_units"):
    return W.metric_series(facts.hour_facts(spark, sf_dir), None, metric, FROM, TO, by=by)


_DEMAND = f"""{S.HOURS}, s AS (SELECT department_code, date AS ds, round(sum(demand_units), 9) AS y
  FROM hours GROUP BY ALL)"""


def _series_query(metric: str):
    sql = f"""
WITH {S.TICKETS} SELECT created_date AS ds, count(*)::DOUBLE AS y FROM tickets GROUP BY ALL""" \
        if metric == "ticket_volume" else f"""
WITH {S.HOURS} SELECT date AS ds, {_r(_MEASURES[metric])} AS y FROM hours GROUP BY ALL"""

    @query(f"g11_series_{metric}", sql)
    def one_series(spark, sf_dir):
        if metric == "ticket_volume":
            return volume(spark, sf_dir, by=())
        return demand(spark, sf_dir, by=(), metric=metric).select("ds", r("y").alias("y"))


for _metric in W.METRICS:
    _series_query(_metric)


@query("g11_series_all_by_department", f"""
WITH {_ALL} SELECT metric, department_code, ds, {_r('y')} AS y FROM s""")
def all_series(spark, sf_dir):
    series = W.all_metric_series(
        facts.hour_facts(spark, sf_dir), facts.ticket_facts(spark, sf_dir), FROM, T_TO, by=DEPT)
    return series.select("metric", *DEPT, "ds", r("y").alias("y"))


@query("g11_series_department", f"""
WITH {S.HOURS} SELECT date AS ds, {_r(_MEASURES['utilization_rate'])} AS y FROM hours
WHERE department_code = 'D3' GROUP BY ALL""")
def series_department(spark, sf_dir):
    series = W.metric_series(facts.hour_facts(spark, sf_dir), None, "utilization_rate", FROM, TO,
                             department="D3")
    return series.select("ds", r("y").alias("y"))


_TICKET_DAYS = """
daily AS (SELECT created_date AS date, count(*) AS ticket_count,
  count(*) FILTER (WHERE priority = 'critical') AS critical_count,
  count(*) FILTER (WHERE sla_breached) AS sla_breaches,
  round(round(avg(resolution_minutes), 9), 0) AS avg_resolution_min
  FROM ticket_records GROUP BY created_date)"""
_HOUR_DAYS = """
daily AS (SELECT date, round(round(avg(utilization_pct), 9), 1) AS utilization_pct,
  count(*) FILTER (WHERE is_absent) AS absent_count,
  round(sum(overtime_hours), 6) AS overtime_hours, count(DISTINCT employee_code) AS headcount
  FROM hour_records GROUP BY date)"""
TICKET_FEATURES = ["ticket_count", "critical_count", "sla_breaches", "avg_resolution_min"]
HOUR_FEATURES = ["utilization_pct", "absent_count", "overtime_hours", "headcount"]


def ticket_days(spark, sf_dir):
    daily = tickets.daily_ticket_measures(facts.ticket_records(spark, sf_dir))
    return daily.select("date", *TICKET_FEATURES)


def hour_days(spark, sf_dir):
    daily = workforce.daily_workforce_measures(facts.hour_records(spark, sf_dir))
    return daily.withColumnRenamed("avg_utilization_pct", "utilization_pct").select(
        "date", *HOUR_FEATURES)


@query("g20_ticket_features", f"WITH {S.TICKET_RECORDS}, {_TICKET_DAYS} SELECT * FROM daily")
def ticket_features(spark, sf_dir):
    return ticket_days(spark, sf_dir)


@query("g21_workforce_features", f"WITH {S.hour_records()}, {_HOUR_DAYS} SELECT * FROM daily")
def workforce_features(spark, sf_dir):
    return hour_days(spark, sf_dir)


@query("g22_forecast_series", f"""
WITH {S.TICKET_RECORDS}, {S.hour_records()}
SELECT 'ticket_volume' AS metric, created_date AS ds, count(*)::DOUBLE AS y
FROM ticket_records GROUP BY created_date
UNION ALL
SELECT 'demand', date, round(round(avg(utilization_pct), 9), 2) FROM hour_records GROUP BY date""")
def forecast_series(spark, sf_dir):
    volume = facts.ticket_records(spark, sf_dir).groupBy(F.col("created_date").alias("ds")).agg(
        F.count("*").cast("double").alias("y"))
    use = facts.hour_records(spark, sf_dir).groupBy(F.col("date").alias("ds")).agg(
        r(r(F.avg("utilization_pct"), 9), 2).alias("y"))
    return volume.select(F.lit("ticket_volume").alias("metric"), "ds", "y").unionByName(
        use.select(F.lit("demand").alias("metric"), "ds", "y"))


# --- windows ------------------------------------------------------------------------------
@query("h1_running_net", f"""
WITH {S.TICKETS}, d AS (SELECT department_code, created_date AS ds,
  count(*) - count(*) FILTER (WHERE status IN ('resolved', 'closed')) AS net
  FROM tickets GROUP BY ALL)
SELECT department_code, ds, CAST(sum(net) OVER (PARTITION BY department_code ORDER BY ds) AS BIGINT)
  AS running_net FROM d""")
def running_net(spark, sf_dir):
    done = F.count_if(F.col("status").isin("resolved", "closed"))
    daily = facts.ticket_facts(spark, sf_dir).groupBy(*DEPT, F.col("created_date").alias("ds")).agg(
        (F.count("*") - done).alias("net"))
    running = W.in_order(DEPT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select(*DEPT, "ds", F.sum("net").over(running).alias("running_net"))


_FRAME = "OVER (PARTITION BY department_code ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query("h2_rolling_mean", f"""
WITH {_DEMAND}
SELECT department_code, ds, CASE WHEN count(y) {_FRAME} >= 3 THEN {_r(f'avg(y) {_FRAME}')} END
  AS rolling_mean FROM s""")
def rolling_mean(spark, sf_dir):
    return demand(spark, sf_dir).select(*DEPT, "ds", r(W.rolling_mean(DEPT)).alias("rolling_mean"))


@query("h3_rolling_std", f"""
WITH {_DEMAND}
SELECT department_code, ds, CASE WHEN count(y) {_FRAME} >= 3 AND stddev_samp(y) {_FRAME} >= 1e-9
  THEN {_r(f'stddev_samp(y) {_FRAME}')} END AS rolling_std FROM s""")
def rolling_std(spark, sf_dir):
    return demand(spark, sf_dir).select(*DEPT, "ds", r(W.rolling_std(DEPT)).alias("rolling_std"))


@query("h4_share_of_total", f"""
WITH {S.TICKETS}
SELECT channel, count(*) AS n, {_r('count(*) / sum(count(*)) OVER () * 100')} AS pct
FROM tickets GROUP BY channel""")
def share_of_total(spark, sf_dir):
    per = facts.ticket_facts(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy()) * 100
    return per.select("channel", "n", r(share).alias("pct"))


@query("h5_position", f"""
WITH {_DEMAND}
SELECT department_code, ds, row_number() OVER (PARTITION BY department_code ORDER BY ds) - 1
  AS position FROM s""")
def position(spark, sf_dir):
    return demand(spark, sf_dir).select(*DEPT, "ds", W.position(DEPT).alias("position"))


@query("h6_tail", f"""
WITH {_DEMAND}, b AS (SELECT *, row_number() OVER (PARTITION BY department_code ORDER BY ds DESC)
  AS back FROM s)
SELECT department_code, ds, {_r('y')} AS y FROM b WHERE back <= 60""")
def tail(spark, sf_dir):
    return W.tail(demand(spark, sf_dir), 60, DEPT).select(*DEPT, "ds", r("y").alias("y"))


@query("h7_days_from_start", f"""
WITH {_DEMAND}
SELECT department_code, ds, ds - min(ds) OVER (PARTITION BY department_code) AS t FROM s""")
def days_from_start(spark, sf_dir):
    return demand(spark, sf_dir).select(*DEPT, "ds", W.days_from_start(DEPT).alias("t"))


@query("h8_half_means", f"""
WITH {S.TICKETS}, {_VOLUME}, b AS (SELECT *,
    row_number() OVER (PARTITION BY department_code ORDER BY ds) AS i,
    count(*) OVER (PARTITION BY department_code) AS n FROM volume)
SELECT department_code, {_r('avg(y) FILTER (WHERE i <= n // 2)')} AS first_half,
  {_r('avg(y) FILTER (WHERE i > n // 2)')} AS second_half
FROM b GROUP BY department_code""")
def half_means(spark, sf_dir):
    rows = volume(spark, sf_dir).withColumns({
        "i": W.position(DEPT) + 1, "n": F.count("y").over(W.whole(DEPT))})
    early = F.col("i") <= F.floor(F.col("n") / 2)
    return rows.groupBy(*DEPT).agg(
        r(F.avg(F.when(early, F.col("y")))).alias("first_half"),
        r(F.avg(F.when(~early, F.col("y")))).alias("second_half"))


@query("h9_dedup_rank", f"""
WITH {S.REPEATED_TICKETS}, ranked AS (SELECT row_number() OVER
  (PARTITION BY ticket_id ORDER BY row_index) AS rank FROM repeated_tickets)
SELECT rank, count(*) AS rows FROM ranked GROUP BY rank""")
def dedup_rank(spark, sf_dir):
    from tidewatch.sources import feeds

    rank = F.row_number().over(Window.partitionBy("ticket_id").orderBy("row_index"))
    return feeds.raw_tickets(spark, sf_dir, repeated=True).select(rank.alias("rank")).groupBy(
        "rank").agg(F.count("*").alias("rows"))


# --- anomalies ----------------------------------------------------------------------------
_SEVERITY = """CASE WHEN abs(z) > 4 THEN 'critical' WHEN abs(z) > 3.5 THEN 'high'
    WHEN abs(z) > 3 THEN 'medium' ELSE 'low' END"""


def _cause(z: str, observed: str, expected: str) -> str:
    size = f"CASE WHEN abs({z}) > 3.5 THEN 'Significant' ELSE 'Notable' END"
    up = f"{observed} > {expected}"
    return f"""CASE metric
    WHEN 'ticket_volume' THEN CASE WHEN {up}
      THEN {size} || ' increase in support demand — check for product issues or outages'
      ELSE {size} || ' drop in ticket volume — possible reporting gap or holiday' END
    WHEN 'absent' THEN CASE WHEN {up}
      THEN {size} || ' absenteeism spike — possible illness outbreak or scheduling conflict'
      ELSE 'Unusually low absences — data completeness check recommended' END
    WHEN 'utilization_rate' THEN CASE WHEN {up}
      THEN 'Over-utilization detected — risk of burnout and quality degradation'
      ELSE {size} || ' under-utilization — demand mismatch or scheduling gap' END
    WHEN 'demand_units' THEN CASE WHEN {up}
      THEN {size} || ' demand surge — verify staffing coverage'
      ELSE {size} || ' demand drop — seasonal or external factor likely' END
    ELSE CASE WHEN {up} THEN {size} || ' upward deviation in ' || metric
      ELSE {size} || ' downward deviation in ' || metric END END"""


_KEYS = "PARTITION BY metric, department_code"
_NEAR = f"OVER ({_KEYS} ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
BY = ["metric", "department_code"]


def _every_series(spark, sf_dir):
    return W.all_metric_series(
        facts.hour_facts(spark, sf_dir), facts.ticket_facts(spark, sf_dir), FROM, T_TO, by=DEPT)


def _shown(found):
    return found.select(
        "department_code", "date", "metric", r("observed_value").alias("observed_value"),
        r("expected_value").alias("expected_value"), r("z_score").alias("z_score"),
        "severity", "likely_cause")


_ZSCORE_SQL = f"""
WITH {_ALL}, m AS (SELECT *, avg(y) {_NEAR} AS mean, stddev_samp(y) {_NEAR} AS std,
    count(y) {_NEAR} AS near, count(*) OVER ({_KEYS}) AS n FROM s),
q AS (SELECT *, (y - mean) / CASE WHEN std >= 1e-9 THEN std END AS z FROM m
  WHERE near >= 3 AND n >= 7)
SELECT department_code, ds AS date, metric, {_r('y')} AS observed_value, {_r('mean')} AS expected_value,
  {_r('z')} AS z_score, {_SEVERITY} AS severity, {_cause('z', 'y', 'mean')} AS likely_cause
FROM q WHERE abs(z) >= 2.0"""


@query("l10_zscore_anomalies", _ZSCORE_SQL)
def zscore_anomalies(spark, sf_dir):
    return _shown(anomaly.zscore_anomalies(
        _every_series(spark, sf_dir), F.col("metric"), threshold=2.0, by=BY))


@query("l10_zscore_exclude_self", f"""
WITH {_ALL}, x AS (SELECT *, list(y) {_NEAR} AS ys, count(*) OVER ({_KEYS}) AS n,
    row_number() OVER ({_KEYS} ORDER BY ds) AS i FROM s),
o AS (SELECT *, list_concat(ys[: least(i - 1, 3)], ys[least(i - 1, 3) + 2 :]) AS others FROM x),
q AS (SELECT *, list_avg(others) AS mean, (y - list_avg(others)) /
    CASE WHEN list_stddev_samp(others) >= 1e-9 THEN list_stddev_samp(others) END AS z
  FROM o WHERE n >= 7 AND len(others) >= 3)
SELECT department_code, ds AS date, metric, {_r('y')} AS observed_value, {_r('mean')} AS expected_value,
  {_r('z')} AS z_score, {_SEVERITY} AS severity, {_cause('z', 'y', 'mean')} AS likely_cause
FROM q WHERE abs(z) >= 2.5""")
def zscore_exclude_self(spark, sf_dir):
    return _shown(anomaly.zscore_anomalies(
        _every_series(spark, sf_dir), F.col("metric"), by=BY, baseline="exclude_self"))


_IQR = f"""
WITH {_ALL}, m AS (SELECT metric, department_code, quantile_cont(y, 0.25) AS q1,
    quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3, count(*) AS n
  FROM s GROUP BY ALL),
q AS (SELECT *, abs(y - median) / ((q3 - q1) / 1.35 + 1e-9) AS z FROM s
  JOIN m USING (metric, department_code)
  WHERE n >= 4 AND (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)))"""


@query("l11_iqr_anomalies", f"""{_IQR}
SELECT department_code, ds AS date, metric, {_r('y')} AS observed_value,
  {_r('median')} AS expected_value, round(z, 2) AS z_score,
  CASE WHEN z < 3.5 THEN 'medium' ELSE 'high' END AS severity,
  {_cause('z', 'y', 'median')} AS likely_cause FROM q""")
def iqr_anomalies(spark, sf_dir):
    return _shown(anomaly.iqr_anomalies(_every_series(spark, sf_dir), F.col("metric"), by=BY))


@query("l12_infer_cause", f"""{_IQR}
SELECT {_cause('z', 'y', 'median')} AS likely_cause, count(*) AS n FROM q GROUP BY ALL""")
def infer_cause(spark, sf_dir):
    found = anomaly.iqr_anomalies(_every_series(spark, sf_dir), F.col("metric"), by=BY)
    return found.groupBy("likely_cause").agg(F.count("*").alias("n"))


def _labels(primary: str) -> str:
    return f"""
z AS (SELECT *, abs(({primary} - avg({primary}) OVER ()) / (stddev_samp({primary}) OVER () + 1e-9)) AS z,
    avg({primary}) OVER () AS mean, stddev_samp({primary}) OVER () AS std, count(*) OVER () AS days
  FROM daily),
flagged AS (SELECT * FROM z WHERE days >= 10
  AND z >= (SELECT quantile_cont(z, 0.95) FROM z) - 1e-12)"""


@query("l14_zscore_labels", f"""
WITH {S.TICKET_RECORDS}, {_TICKET_DAYS}, {_labels('ticket_count')}
SELECT date, z.z >= (SELECT quantile_cont(z, 0.95) FROM z) - 1e-12 AS is_anomaly,
  {_r('-z')} AS anomaly_score FROM z""")
def zscore_labels(spark, sf_dir):
    scored = anomaly.zscore_labels(ticket_days(spark, sf_dir), "ticket_count")
    return scored.select("date", "is_anomaly", r("anomaly_score").alias("anomaly_score"))


_TICKET_REASONS = """list_filter([
    CASE WHEN ticket_count > mean + 2 * std THEN
      'Unusually high ticket volume — possible system incident or product release' END,
    CASE WHEN critical_count > 0 THEN 'Critical tickets present: ' || critical_count END,
    CASE WHEN sla_breaches > mean * 0.3 THEN
      'Elevated SLA breach rate — may indicate staffing shortage' END], lambda x: x IS NOT NULL)"""
_HOUR_REASONS = """list_filter([
    CASE WHEN utilization_pct < mean - 2 * std THEN
      'Unusually low utilization — possible mass absence or public holiday' END,
    CASE WHEN absent_count > 0 THEN 'High absence: ' || absent_count || ' employees absent' END,
    CASE WHEN overtime_hours > mean * 1.5 THEN
      'High overtime — demand likely exceeding capacity' END], lambda x: x IS NOT NULL)"""


def _reasons_sql(primary: str, reasons: str, fields: list[str]) -> str:
    other = (f"['Value ' || CASE WHEN {primary} > mean THEN 'above' ELSE 'below' END || "
             "' historical norm by ' || printf('%.1f', round(z, 1)) || ' standard deviations']")
    shown = ", ".join(f"{_r(f, 2)} AS {f}" for f in fields if f != primary)
    return f"""
SELECT date, round(CAST({primary} AS DOUBLE), 2) AS observed_value, {_r('mean - 2 * std', 2)} AS expected_lo,
  {_r('mean + 2 * std', 2)} AS expected_hi,
  CASE WHEN z > 3 THEN 'critical' ELSE 'warning' END AS severity, {_r('-z', 4)} AS anomaly_score,
  array_to_string(CASE WHEN len({reasons}) > 0 THEN {reasons} ELSE {other} END, '; ') AS reasons,
  {shown}
FROM flagged"""


def _report(found, features, primary):
    return found.select(
        "date", "observed_value", F.col("expected_range.lo").alias("expected_lo"),
        F.col("expected_range.hi").alias("expected_hi"), "severity", "anomaly_score",
        F.array_join("likely_reasons", "; ").alias("reasons"),
        *[F.col("correlated_fields")[f].alias(f) for f in features if f != primary])


@query("l15_reasons_tickets", f"""
WITH {S.TICKET_RECORDS}, {_TICKET_DAYS}, {_labels('ticket_count')}
{_reasons_sql('ticket_count', _TICKET_REASONS, TICKET_FEATURES)}""")
def reasons_tickets(spark, sf_dir):
    found = anomaly.multivariate_anomalies(
        ticket_days(spark, sf_dir), "ticket_count", "tickets", TICKET_FEATURES, method="zscore")
    return _report(found, TICKET_FEATURES, "ticket_count")


@query("l15_reasons_workforce", f"""
WITH {S.hour_records()}, {_HOUR_DAYS}, {_labels('utilization_pct')}
{_reasons_sql('utilization_pct', _HOUR_REASONS, HOUR_FEATURES)}""")
def reasons_workforce(spark, sf_dir):
    found = anomaly.multivariate_anomalies(
        hour_days(spark, sf_dir), "utilization_pct", "workforce", HOUR_FEATURES, method="zscore")
    return _report(found, HOUR_FEATURES, "utilization_pct")


@query("l13_multivariate_tickets")
def multivariate_tickets(spark, sf_dir):
    found = anomaly.multivariate_anomalies(
        ticket_days(spark, sf_dir), "ticket_count", "tickets", TICKET_FEATURES)
    return _report(found, TICKET_FEATURES, "ticket_count").orderBy("anomaly_score")


@query("l13_multivariate_workforce")
def multivariate_workforce(spark, sf_dir):
    found = anomaly.multivariate_anomalies(
        hour_days(spark, sf_dir), "utilization_pct", "workforce", HOUR_FEATURES)
    return _report(found, HOUR_FEATURES, "utilization_pct").orderBy("anomaly_score")


@query("l16_anomaly_summary", f"""
WITH {S.hour_records()}, {_HOUR_DAYS}, {_labels('utilization_pct')},
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE z > 3) AS crit,
  count(*) FILTER (WHERE z <= 3) AS warn,
  list_sort(list(CAST(date AS VARCHAR)) FILTER (WHERE z > 3)) AS dates, max(days) AS days FROM flagged)
SELECT n AS anomalies, crit AS critical, warn AS warnings, round(n / days, 4) AS anomaly_rate,
  concat_ws(' ', 'Detected ' || n || ' anomalies in utilization pct:',
    CASE WHEN crit > 0 THEN crit || ' critical (dates: ' || array_to_string(dates[:3], ', ')
      || CASE WHEN crit > 3 THEN '...' ELSE '' END || ')' END,
    CASE WHEN warn > 0 THEN warn || ' warnings' END) || '.' AS summary
FROM c""")
def anomaly_summary(spark, sf_dir):
    found = anomaly.multivariate_anomalies(
        hour_days(spark, sf_dir), "utilization_pct", "workforce", HOUR_FEATURES, method="zscore")
    return anomaly.anomaly_summary(found, "utilization_pct")


def _iqr_reports_sql(rows: str) -> str:
    return f"""
WITH {S.TICKETS}, {_VOLUME}, v AS (SELECT * FROM volume WHERE {rows}),
q AS (SELECT department_code, ds, y, count(*) OVER w AS n, quantile_cont(y, 0.25) OVER w AS q1,
  quantile_cont(y, 0.75) OVER w AS q3 FROM v WINDOW w AS (PARTITION BY department_code)),
per AS (SELECT department_code, count(*) AS total_points, count(*) FILTER (WHERE n >= 4
  AND (y < q1 - 1.0 * (q3 - q1) OR y > q3 + 1.0 * (q3 - q1))) AS anomalies FROM q GROUP BY department_code)
SELECT department_code, total_points, anomalies, 0 AS critical, anomalies AS warnings,
  round(anomalies / total_points, 4) AS anomaly_rate,
  CASE WHEN total_points < 4 THEN 'none — insufficient data' ELSE 'IQR' END AS detection_method,
  CASE WHEN total_points < 4 THEN 'Not enough data for anomaly detection (minimum 4 data points).'
    WHEN anomalies = 0 THEN 'No anomalies detected in ticket_volume.'
    ELSE 'Detected ' || anomalies || ' anomalies in ticket volume: ' || anomalies || ' warnings.' END AS summary
FROM per"""


@query("l11_iqr_reports", _iqr_reports_sql("department_code <> 'HR' OR ds <= DATE '2024-01-03'"))
def iqr_reports(spark, sf_dir):
    """A row for every department: HR has three days only and says so, quiet ones say that nothing was found."""
    rows = volume(spark, sf_dir).filter(
        (F.col("department_code") != "HR") | (F.col("ds") <= F.lit("2024-01-03").cast("date")))
    found = anomaly.iqr_anomalies(rows, "ticket_volume", 1.0, by=DEPT)
    return anomaly.detector_reports(rows, found, "ticket_volume", "IQR", 4, DEPT)


@query("l17_severity_counts", f"""{_IQR}, found AS (
  SELECT CASE WHEN z < 3.5 THEN 'medium' ELSE 'high' END AS severity FROM q)
SELECT l.severity, count(f.severity) AS count
FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) l(severity)
LEFT JOIN found f ON f.severity = l.severity GROUP BY l.severity""")
def severity_counts(spark, sf_dir):
    found = anomaly.iqr_anomalies(_every_series(spark, sf_dir), F.col("metric"), by=BY)
    return anomaly.severity_counts(found)


# --- forecasts ------------------------------------------------------------------------------
_FEATURES_SQL = """isodow(ds) - 1 AS day_of_week, day(ds) AS day_of_month, month(ds) AS month,
    week(ds) AS week_of_year, ds - start AS t,
    sin(2 * pi() * (isodow(ds) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ds) - 1) / 7) AS dow_cos,
    sin(2 * pi() * month(ds) / 12) AS month_sin, cos(2 * pi() * month(ds) / 12) AS month_cos"""


@query("l1_time_features", f"""
WITH {_DEMAND}, f AS (SELECT *, min(ds) OVER (PARTITION BY department_code) AS start FROM s),
g AS (SELECT department_code, ds, {_FEATURES_SQL} FROM f)
SELECT department_code, ds, {', '.join(f'{_r(n, 9)} AS {n}' for n in FEATURES)} FROM g""")
def time_features(spark, sf_dir):
    rows = forecast.feature_frame(demand(spark, sf_dir), DEPT)
    return rows.select(*DEPT, "ds", *[r(F.col(n), 9).alias(n) for n in FEATURES])


def _ridge_sql(source: str, table: str, future_start: str) -> str:
    """Normal equations per series, solved by Gauss-Jordan steps in a recursive query."""
    horizon = HORIZON
    n = len(FEATURES)
    key = "PARTITION BY department_code"
    scaled = ", ".join(f"({f} - m_{f}) / s_{f} AS z_{f}" for f in FEATURES)
    stats = ", ".join(
        f"avg({f}) OVER ({key}) AS m_{f}, CASE WHEN stddev_pop({f}) OVER ({key}) > 1e-12 "
        f"THEN stddev_pop({f}) OVER ({key}) ELSE 1.0 END AS s_{f}" for f in FEATURES)
    matrix = ", ".join("[" + ", ".join(
        [f"sum(z_{a} * z_{b}){' + 1.0' if a == b else ''}" for b in FEATURES]
        + [f"sum(z_{a} * (y - ybar))"]) + "]" for a in FEATURES)
    kept = ", ".join(f"any_value(m_{f}) AS m_{f}, any_value(s_{f}) AS s_{f}" for f in FEATURES)
    dot = " + ".join(f"m[{i + 1}][{n + 1}] * z_{f}" for i, f in enumerate(FEATURES))
    return f"""
WITH RECURSIVE {source},
f AS (SELECT *, min(ds) OVER ({key}) AS start FROM {table}),
g AS (SELECT department_code, ds, y, {_FEATURES_SQL} FROM f),
h AS (SELECT *, avg(y) OVER ({key}) AS ybar, {stats} FROM g),
z AS (SELECT *, {scaled} FROM h),
model AS (SELECT department_code, [{matrix}] AS m0, any_value(ybar) AS ybar, min(ds) AS first,
  max(ds) AS last, {kept}
  FROM z GROUP BY department_code),
steps AS (
  SELECT department_code, 1 AS k, m0 AS m FROM model
  UNION ALL
  SELECT department_code, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k
      THEN list_transform(row, lambda x: x / row[k])
      ELSE list_transform(row, lambda x, j: x - row[k] * m[k][j] / m[k][k]) END)
  FROM steps WHERE k <= {n}
),
solved AS (SELECT * FROM steps JOIN model USING (department_code) WHERE k = {n + 1}),
fitted AS (SELECT z.department_code, z.ds, z.y, solved.ybar + {dot} AS p FROM z
  JOIN solved USING (department_code)),
quality AS (SELECT department_code, stddev_pop(y - p) AS sigma, avg(abs(y - p)) AS mae,
  sqrt(avg((y - p) * (y - p))) AS rmse FROM fitted GROUP BY department_code),
days AS (SELECT solved.*, last + i::INTEGER AS ds, {future_start} AS start FROM solved,
  range(1, {horizon + 1}) r(i)),
ahead AS (SELECT * EXCLUDE (month), {_FEATURES_SQL} FROM (SELECT *, 0 AS month FROM days)),
guess AS (SELECT *, {', '.join(f'({f} - m_{f}) / s_{f} AS z_{f}' for f in FEATURES)} FROM ahead),
points AS (
  SELECT department_code, ds, p AS predicted, p - 1.96 * sigma AS lower_bound,
    p + 1.96 * sigma AS upper_bound, FALSE AS is_forecast, mae, rmse
  FROM fitted JOIN quality USING (department_code)
  UNION ALL
  SELECT department_code, ds, greatest(ybar + {dot}, 0), greatest(ybar + {dot} - 1.96 * sigma, 0),
    greatest(ybar + {dot} + 1.96 * sigma, 0), TRUE, mae, rmse
  FROM guess JOIN quality USING (department_code)
)
SELECT department_code, ds, {_r('predicted')} AS predicted, {_r('lower_bound')} AS lower_bound,
  {_r('upper_bound')} AS upper_bound, is_forecast, {_r('mae')} AS mae, {_r('rmse')} AS rmse
FROM points"""


def _ridge(points):
    return points.select(
        *DEPT, "ds", *[r(c).alias(c) for c in ("predicted", "lower_bound", "upper_bound")],
        "is_forecast", r("mae").alias("mae"), r("rmse").alias("rmse"))


@query("l2_ridge_forecast", _ridge_sql(f"{S.TICKETS}, {_VOLUME}", "volume", "last + 1"))
def ridge_forecast(spark, sf_dir):
    return _ridge(forecast.ridge_forecast(volume(spark, sf_dir), DEPT, HORIZON))


@query("l2_ridge_demand_extrapolated", _ridge_sql(_DEMAND, "s", "first"))
def ridge_demand(spark, sf_dir):
    series = demand(spark, sf_dir)
    return _ridge(forecast.ridge_forecast(series, DEPT, HORIZON, extrapolate_trend=True))


_LINEAR = f"""
{S.TICKETS}, {_VOLUME},
i AS (SELECT *, row_number() OVER (PARTITION BY department_code ORDER BY ds) - 1 AS i,
  row_number() OVER (PARTITION BY department_code ORDER BY ds DESC) AS back FROM volume),
fit AS (SELECT department_code, regr_slope(y, i) AS slope, regr_intercept(y, i) AS icept,
  count(*) AS points, max(ds) AS last_ds, avg(y) FILTER (WHERE back <= 7) AS recent_avg
  FROM i GROUP BY department_code),
res AS (SELECT department_code, stddev_pop(y - (slope * i + icept)) AS sigma
  FROM i JOIN fit USING (department_code) GROUP BY department_code),
model AS (SELECT *, CASE WHEN slope > 0.1 THEN 'up' WHEN slope < -0.1 THEN 'down' ELSE 'flat' END
  AS trend_direction FROM fit JOIN res USING (department_code)),
ahead AS (SELECT model.*, h, slope * (points + h) + icept AS v FROM model, range(0, {HORIZON}) r(h))"""


@query("l3_linear_trend_forecast", f"""
WITH {_LINEAR}
SELECT department_code, points, last_ds, {_r('sigma')} AS sigma, trend_direction,
  {_r('slope * points + icept')} AS first_value,
  {_r(f'slope * (points + {HORIZON - 1}) + icept')} AS last_value
FROM model""")
def linear_trend(spark, sf_dir):
    models = forecast.run_forecast(volume(spark, sf_dir), DEPT, HORIZON)
    return models.select(
        *DEPT, "points", "last_ds", r("sigma").alias("sigma"), "trend_direction",
        r(F.element_at("values", 1)).alias("first_value"),
        r(F.element_at("values", -1)).alias("last_value"))


_WEEKS = f"""
{S.TICKETS}, {_VOLUME}, w AS (SELECT department_code, week(ds) AS week, ds, y FROM volume)"""
WEEK_KEYS = ["department_code", "week"]


def _weeks(spark, sf_dir):
    return volume(spark, sf_dir).withColumn("week", F.weekofyear("ds"))


@query("l4_naive_forecast", f"""
WITH {_WEEKS}
SELECT department_code, week, count(*) AS points, {_r('avg(y)')} AS value,
  {_r('coalesce(stddev_samp(y), 0.0)')} AS sigma, 'flat' AS trend_direction
FROM w GROUP BY ALL HAVING count(*) < 7""")
def naive_forecast(spark, sf_dir):
    """Weeks as series: the last one has fewer than seven days."""
    models = forecast.run_forecast(_weeks(spark, sf_dir), WEEK_KEYS, HORIZON)
    return models.filter(F.col("methodology") == "Naive Mean Forecast").select(
        *WEEK_KEYS, "points", r(F.element_at("values", 1)).alias("value"),
        r("sigma").alias("sigma"), "trend_direction")


@query("l5_holt_winters_forecast")
def holt_winters(spark, sf_dir):
    models = forecast.run_forecast(volume(spark, sf_dir), DEPT, HORIZON, smoothing=True)
    return forecast.summarize(models, "ticket_volume", HORIZON).select(
        *DEPT, "methodology", "points", r("mape", 1).alias("mape"), "trend_direction", "summary")


_ALPHA, _BETA, _GAMMA = 0.3, 0.1, 0.2


@query("l5_holt_winters_fixed", f"""
WITH RECURSIVE {S.TICKETS}, {_VOLUME},
a AS (SELECT department_code, list(y ORDER BY ds) AS y, count(*) AS n FROM volume GROUP BY department_code),
b AS (SELECT *, greatest(7, floor(n * 0.2)::BIGINT) AS held, CASE WHEN n >= 28 THEN 7 ELSE 1 END AS m FROM a),
runs AS (SELECT department_code, TRUE AS whole, m, y AS v FROM b
  UNION ALL SELECT department_code, FALSE, m, y[1 : n - held] FROM b),
begun AS (SELECT *, CASE WHEN m = 7 THEN list_avg(v[1:7]) ELSE v[1] END AS level FROM runs),
rec AS (
  SELECT department_code, whole, m, v, 0 AS t, level,
    CASE WHEN m = 7 THEN (list_avg(v[8:14]) - level) / 7 ELSE v[2] - v[1] END AS trend,
    CASE WHEN m = 7 THEN list_transform(v[1:7], lambda x: x - level) ELSE [0.0::DOUBLE] END AS season,
    0.0::DOUBLE AS errors, 0.0::DOUBLE AS squares
  FROM begun
  UNION ALL
  SELECT department_code, whole, m, v, t + 1, l, {_BETA}::DOUBLE * (l - level) + (1 - {_BETA}::DOUBLE) * trend,
    CASE WHEN m = 7 THEN list_transform(season, lambda x, k: CASE WHEN k = t % m + 1
      THEN {_GAMMA}::DOUBLE * (y - l) + (1 - {_GAMMA}::DOUBLE) * s ELSE x END) ELSE season END,
    errors + (y - level - trend - s), squares + (y - level - trend - s) * (y - level - trend - s)
  FROM (SELECT *, {_ALPHA}::DOUBLE * (y - s) + (1 - {_ALPHA}::DOUBLE) * (level + trend) AS l
        FROM (SELECT *, v[t + 1] AS y, season[t % m + 1] AS s FROM rec WHERE t < len(v)))),
ended AS (SELECT * FROM rec WHERE t = len(v)),
missed AS (
  SELECT department_code, avg(abs((y - guess) / y)) * 100 AS mape
  FROM (SELECT department_code, b.y[t + i] AS y, level + i * trend + season[(t + i - 1) % e.m + 1] AS guess
        FROM ended e JOIN b USING (department_code), range(1, 1000) r(i) WHERE NOT whole AND i <= held)
  WHERE y <> 0 GROUP BY department_code)
SELECT department_code, h AS step, round(level + h * trend + season[(t + h - 1) % m + 1], 6) AS value,
  round(mape, 6) AS mape, round(sqrt(greatest((squares - errors * errors / t) / (t - 1), 0)), 6) AS sigma
FROM ended JOIN missed USING (department_code), range(1, {HORIZON} + 1) r(h) WHERE whole""")
def holt_winters_fixed(spark, sf_dir):
    """The smoothing recursion itself: forecast, holdout error and residual deviation at given parameters."""
    models = smoothing.smoothing_forecast(volume(spark, sf_dir), DEPT, HORIZON, _ALPHA, _BETA, _GAMMA)
    return models.select(
        *DEPT, F.round("mape", 6).alias("mape"), F.round("sigma", 6).alias("sigma"),
        F.posexplode("values").alias("_step", "_value"),
    ).select(*DEPT, (F.col("_step") + 1).cast("long").alias("step"), F.round("_value", 6).alias("value"),
             "mape", "sigma")


@query("l6_build_points", f"""
WITH {_LINEAR}
SELECT department_code, ds, round(y, 2) AS forecast, round(y, 2) AS lower_ci, round(y, 2) AS upper_ci,
  TRUE AS is_actual, round(y, 2) AS actual FROM i WHERE back <= 60
UNION ALL
SELECT department_code, last_ds + (h + 1)::INTEGER, round(greatest(v, 0), 2),
  round(greatest(v - 1.96 * sigma * (1 + h * 0.02), 0), 2),
  round(greatest(v + 1.96 * sigma * (1 + h * 0.02), 0), 2), FALSE, NULL
FROM ahead""")
def build_points(spark, sf_dir):
    models = forecast.run_forecast(volume(spark, sf_dir), DEPT, HORIZON)
    return forecast.build_points(models, DEPT)


@query("l7_detect_trend", f"""
WITH {_LINEAR}, halves AS (SELECT department_code, avg(v) FILTER (WHERE h < {HORIZON // 2}) AS a,
  avg(v) FILTER (WHERE h >= {HORIZON // 2}) AS b FROM ahead GROUP BY department_code)
SELECT department_code, CASE WHEN (b - a) / (a + 1e-9) > 0.05 THEN 'up'
  WHEN (b - a) / (a + 1e-9) < -0.05 THEN 'down' ELSE 'flat' END AS trend FROM halves""")
def detect_trend(spark, sf_dir):
    models = forecast.run_forecast(volume(spark, sf_dir), DEPT, HORIZON)
    return models.select(*DEPT, forecast.detect_trend(F.col("values"), HORIZON).alias("trend"))


@query("l8_summarize_forecast", f"""
WITH {_LINEAR}, m AS (SELECT department_code, any_value(recent_avg) AS recent, avg(v) AS mean,
    any_value(trend_direction) AS trend FROM ahead GROUP BY department_code),
p AS (SELECT *, (mean - recent) / (recent + 1e-9) * 100 AS pct FROM m)
SELECT department_code, 'Ticket Volume is forecast to '
  || CASE WHEN pct > 0 THEN 'increase' ELSE 'decrease' END || ' by ' || printf('%.1f', round(abs(pct), 1))
  || '% over the next {HORIZON} days (from avg ' || printf('%.1f', round(recent, 1)) || ' to '
  || printf('%.1f', round(mean, 1)) || '). Trend direction: ' || trend || '.' AS summary
FROM p""")
def summarize_forecast(spark, sf_dir):
    models = forecast.run_forecast(volume(spark, sf_dir), DEPT, HORIZON)
    return forecast.summarize(models, "ticket_volume", HORIZON).select(*DEPT, "summary")


@query("l9_run_forecast", f"""
WITH {_WEEKS}
SELECT department_code, week, count(*) AS points, CASE WHEN count(*) < 7 THEN 'Naive Mean Forecast'
  ELSE 'Linear Trend Regression' END AS methodology FROM w GROUP BY ALL""")
def run_forecast(spark, sf_dir):
    models = forecast.run_forecast(_weeks(spark, sf_dir), WEEK_KEYS, HORIZON)
    return models.select(*WEEK_KEYS, "points", "methodology")


@query("l9_forecast_demand", f"""
WITH {S.hour_records()}, s AS (SELECT date AS ds, round(round(avg(utilization_pct), 9), 2) AS y
  FROM hour_records GROUP BY date),
i AS (SELECT *, row_number() OVER (ORDER BY ds) - 1 AS i FROM s)
SELECT 'demand' AS metric, count(*) AS points, 'Linear Trend Regression' AS methodology,
  CASE WHEN regr_slope(y, i) > 0.1 THEN 'up' WHEN regr_slope(y, i) < -0.1 THEN 'down' ELSE 'flat' END
    AS trend_direction FROM i""")
def forecast_demand(spark, sf_dir):
    series = forecast_series(spark, sf_dir).filter("metric = 'demand'").drop("metric")
    return forecast.forecast_demand(series, horizon=HORIZON).select(
        "metric", "points", "methodology", "trend_direction")
