"""Named queries: column operators, cleaners, validation and dedup over the feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.operators import cleaning
from tidewatch.operators.dedup import dedup
from tidewatch.operators.validation import validate
from tidewatch.plans import feed_sql as S
from tidewatch.plans.facts import AS_OF
from tidewatch.plans.registry import query
from tidewatch.sources import feeds

_TEXT = "'%Y-%m-%d %H:%M:%S'"


def text(name: str):
    """A timestamp as text, so that no engine's own time type takes part in the comparison."""
    return F.col(name).cast("string").alias(name)


def _sql_text(name: str) -> str:
    return f"strftime({name}, {_TEXT}) AS {name}"


# --- column operators -----------------------------------------------------------------
@query("b1_normalize_columns", f"""
WITH {S.RAW_EMPLOYEES}
SELECT employee_code, full_name, hire_date FROM raw_employees""")
def normalize_columns(spark, sf_dir):
    feed = feeds.raw_employees(spark, sf_dir).select("employee_code", "full_name", "hire_date")
    messy = feed.toDF("  Employee Code", "FULL-name ", "Hire Date")
    return C.normalize_columns(messy, "records")


@query("b3_coerce_numeric", f"""
WITH {S.raw_workforce()}
SELECT employee_id, date, coalesce(try_cast(scheduled_hours AS DOUBLE), 0.0) AS scheduled_hours,
  coalesce(try_cast(actual_hours AS DOUBLE), 0.0) AS actual_hours FROM raw_workforce""")
def coerce_numeric(spark, sf_dir):
    return feeds.raw_workforce(spark, sf_dir).select(
        "employee_id", "date",
        *[C.coerce_numeric(F.col(c)).alias(c) for c in ("scheduled_hours", "actual_hours")])


@query("b4_coerce_timestamp", f"""
WITH {S.RAW_TICKETS}
SELECT ticket_id, strftime(try_cast(created_at AS TIMESTAMP), {_TEXT}) AS created_at,
  strftime(try_cast(resolved_at AS TIMESTAMP), {_TEXT}) AS resolved_at FROM raw_tickets""")
def coerce_timestamp(spark, sf_dir):
    return feeds.raw_tickets(spark, sf_dir).select(
        "ticket_id",
        *[C.to_moment(F.col(c)).cast("string").alias(c) for c in ("created_at", "resolved_at")])


@query("b5_standardize_enum", f"""
WITH {S.RAW_TICKETS}
SELECT ticket_id,
  CASE WHEN lower(trim(priority)) IN ('low', 'medium', 'high', 'critical')
    THEN lower(trim(priority)) ELSE 'medium' END AS priority,
  CASE WHEN lower(trim(status)) IN ('open', 'in_progress', 'resolved', 'closed')
    THEN lower(trim(status)) ELSE 'open' END AS status
FROM raw_tickets""")
def standardize_enum(spark, sf_dir):
    return feeds.raw_tickets(spark, sf_dir).select(
        "ticket_id",
        C.standardize_enum(F.col("priority"), V.PRIORITIES, "medium").alias("priority"),
        C.standardize_enum(F.col("status"), V.STATUSES, "open").alias("status"))


@query("b6_map_values", f"""
WITH {S.RAW_TICKETS}, p AS (SELECT ticket_id, lower(trim(priority)) AS priority FROM raw_tickets)
SELECT ticket_id,
  CASE priority WHEN 'critical' THEN 4 WHEN 'high' THEN 8 WHEN 'medium' THEN 24 WHEN 'low' THEN 72
    END AS sla_hours,
  CASE priority WHEN 'critical' THEN 240 WHEN 'high' THEN 480 WHEN 'medium' THEN 1440
    WHEN 'low' THEN 4320 END AS sla_minutes
FROM p""")
def map_values(spark, sf_dir):
    priority = F.lower(F.trim("priority"))
    return feeds.raw_tickets(spark, sf_dir).select(
        "ticket_id", C.map_values(priority, V.SLA_HOURS).alias("sla_hours"),
        C.map_values(priority, V.SLA_MINUTES).alias("sla_minutes"))


@query("b7_clip", f"""
WITH {S.RAW_MARKET}
SELECT title, least(greatest(CAST(sentiment_score AS DOUBLE), -1.0), 1.0) AS sentiment_score
FROM raw_market""")
def clip(spark, sf_dir):
    score = C.clip(C.to_number(F.col("sentiment_score")), -1.0, 1.0)
    return feeds.raw_market(spark, sf_dir).select("title", score.alias("sentiment_score"))


@query("b8_default_column", f"""
WITH {S.RAW_TICKETS}, {S.raw_workforce()}
SELECT 'tickets' AS feed, coalesce(channel, 'portal') AS value, 'active' AS status, count(*) AS n
FROM raw_tickets GROUP BY ALL
UNION ALL
SELECT 'workforce', coalesce(department_code, 'UNKNOWN'), 'active', count(*)
FROM raw_workforce GROUP BY ALL""")
def default_column(spark, sf_dir):
    tickets = C.with_default(feeds.raw_tickets(spark, sf_dir), "channel", "portal").select(
        F.lit("tickets").alias("feed"), F.col("channel").alias("value"))
    hours = C.with_default(
        feeds.raw_workforce(spark, sf_dir), "department_code", V.DEFAULT_DEPARTMENT
    ).select(F.lit("workforce").alias("feed"), F.col("department_code").alias("value"))
    both = C.with_default(tickets.drop("status").unionByName(hours), "status_given", "active")
    return both.groupBy("feed", "value", F.col("status_given").alias("status")).agg(
        F.count("*").alias("n"))


@query("b9_strip_upper_lower", f"""
WITH {S.RAW_EMPLOYEES}
SELECT upper(trim(employee_code)) AS employee_code, lower(trim(email)) AS email,
  trim(full_name) AS full_name FROM raw_employees""")
def strip_upper_lower(spark, sf_dir):
    return feeds.raw_employees(spark, sf_dir).select(
        F.upper(F.trim("employee_code")).alias("employee_code"),
        F.lower(F.trim("email")).alias("email"), F.trim("full_name").alias("full_name"))


@query("b10_parse_tags", f"""
WITH {S.RAW_MARKET}, t AS (
  SELECT title, CASE WHEN tags <> '' THEN list_filter(
    list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> '') END AS tags
  FROM raw_market)
SELECT title, array_to_string(tags, '|') AS tags, len(tags) AS n_tags FROM t""")
def parse_tags(spark, sf_dir):
    tags = C.parse_tags(F.col("tags"))
    return feeds.raw_market(spark, sf_dir).select(
        "title", F.array_join(tags, "|").alias("tags"),
        F.when(tags.isNotNull(), F.size(tags)).alias("n_tags"))


_HOURS_SQL = """h AS (
  SELECT employee_id, date, coalesce(try_cast(scheduled_hours AS DOUBLE), 0.0) AS s,
    coalesce(try_cast(actual_hours AS DOUBLE), 0.0) AS a FROM raw_workforce)"""


def _hours(spark, sf_dir):
    return feeds.raw_workforce(spark, sf_dir).select(
        "employee_id", "date", C.coerce_numeric(F.col("scheduled_hours")).alias("s"),
        C.coerce_numeric(F.col("actual_hours")).alias("a"))


@query("b11_clamp_negative", f"""
WITH {S.raw_workforce()}, {_HOURS_SQL}
SELECT employee_id, date, greatest(a, 0.0) AS actual_hours FROM h""")
def clamp_negative(spark, sf_dir):
    return _hours(spark, sf_dir).select(
        "employee_id", "date", C.clamp_negative(F.col("a")).alias("actual_hours"))


@query("b12_utilization_rate", f"""
WITH {S.raw_workforce()}, {_HOURS_SQL}
SELECT employee_id, date, CASE WHEN s > 0 THEN least(greatest(a / s, 0.0), 2.0) ELSE 0.0 END
  AS utilization_rate FROM h""")
def utilization_rate(spark, sf_dir):
    rate = C.utilization_rate(F.col("a"), F.col("s"))
    return _hours(spark, sf_dir).select("employee_id", "date", rate.alias("utilization_rate"))


@query("b13_utilization_pct", f"""
WITH {S.raw_workforce()}, {_HOURS_SQL}
SELECT employee_id, date, CASE WHEN s > 0 THEN round(a / s * 100, 1) + 0.0 END AS utilization_pct
FROM h""")
def utilization_pct(spark, sf_dir):
    pct = C.utilization_pct(F.col("a"), F.col("s"))
    return _hours(spark, sf_dir).select("employee_id", "date", pct.alias("utilization_pct"))


@query("b14_overtime_hours", f"""
WITH {S.raw_workforce()}, {_HOURS_SQL}
SELECT employee_id, date, greatest(a - s, 0.0) AS overtime_hours FROM h""")
def overtime_hours(spark, sf_dir):
    return _hours(spark, sf_dir).select(
        "employee_id", "date", C.overtime(F.col("a"), F.col("s")).alias("overtime_hours"))


@query("b15_absent", f"""
WITH {S.raw_workforce()}
SELECT employee_id, count(*) FILTER (WHERE coalesce(try_cast(actual_hours AS DOUBLE), 0.0) <= 0)
  AS absences FROM raw_workforce GROUP BY employee_id""")
def absent(spark, sf_dir):
    hours = _hours(spark, sf_dir).withColumn("a", C.clamp_negative(F.col("a")))
    return hours.groupBy("employee_id").agg(F.count_if(F.col("a") == 0).alias("absences"))


_TIMES_SQL = """t AS (
  SELECT ticket_id, try_cast(created_at AS TIMESTAMP) AS c, try_cast(resolved_at AS TIMESTAMP) AS r,
    CASE WHEN lower(trim(priority)) IN ('low', 'medium', 'high', 'critical')
      THEN lower(trim(priority)) ELSE 'medium' END AS p,
    lower(trim(status)) AS st FROM raw_tickets),
u AS (SELECT *, (epoch_us(r) - epoch_us(c)) / 3.6e9 AS hours,
  CASE p WHEN 'critical' THEN 4 WHEN 'high' THEN 8 WHEN 'medium' THEN 24 ELSE 72 END AS target
  FROM t)"""


def _times(spark, sf_dir):
    priority = C.standardize_enum(F.col("priority"), V.PRIORITIES, "medium")
    return feeds.raw_tickets(spark, sf_dir).select(
        "ticket_id", C.to_moment(F.col("created_at")).alias("c"),
        C.to_moment(F.col("resolved_at")).alias("r"),
        F.lower(F.trim("status")).alias("st"),
        C.map_values(priority, V.SLA_HOURS).alias("target"))


@query("b16_actual_resolution_hours", f"""
WITH {S.RAW_TICKETS}, {_TIMES_SQL}
SELECT ticket_id, hours AS actual_resolution_hours FROM u""")
def actual_resolution_hours(spark, sf_dir):
    hours = C.hours_between(F.col("c"), F.col("r"))
    return _times(spark, sf_dir).select("ticket_id", hours.alias("actual_resolution_hours"))


@query("b17_resolution_minutes", f"""
WITH {S.RAW_TICKETS}, {_TIMES_SQL}
SELECT ticket_id, CAST(round_even((epoch_us(r) - epoch_us(c)) / 6e7, 0) AS BIGINT)
  AS resolution_minutes FROM u""")
def resolution_minutes(spark, sf_dir):
    minutes = C.resolution_minutes(F.col("c"), F.col("r"))
    return _times(spark, sf_dir).select("ticket_id", minutes.alias("resolution_minutes"))


@query("b18_sla_breached", f"""
WITH {S.RAW_TICKETS}, {_TIMES_SQL}
SELECT ticket_id, coalesce(hours > target, FALSE) AS sla_breached FROM u""")
def sla_breached(spark, sf_dir):
    taken = C.hours_between(F.col("c"), F.col("r"))
    return _times(spark, sf_dir).select(
        "ticket_id", C.breached(taken, F.col("target")).alias("sla_breached"))


@query("b19_open_overdue", f"""
WITH {S.RAW_TICKETS}, {_TIMES_SQL}
SELECT ticket_id, coalesce(st IN ('open', 'in_progress')
  AND (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(c)) / 3.6e9 > target, FALSE) AS overdue FROM u""")
def open_overdue(spark, sf_dir):
    now = F.lit(AS_OF).cast("timestamp_ntz")
    late = C.open_overdue(F.col("st"), F.col("c"), F.col("target"), now)
    return _times(spark, sf_dir).select("ticket_id", late.alias("overdue"))


_RAW_HOURS_JSON = """to_json({employee_id: employee_id, date: raw_date, scheduled_hours: raw_s,
    actual_hours: raw_a, tasks_completed: raw_t, tasks_assigned: '10', demand_units: raw_d,
    capacity_units: raw_c, department_code: raw_dep, location_code: location_code})"""


@query("b20_split_invalid", f"""
WITH {S.raw_workforce()}, f AS (
  SELECT *, row_number() OVER (PARTITION BY employee_id, date ORDER BY {S.ORDER}) AS rn
  FROM raw_workforce)
SELECT CASE WHEN try_cast(date AS DATE) IS NULL THEN 'invalid_date' ELSE 'hours_out_of_range' END
    AS error_code,
  l_orderkey, l_linenumber,
  CAST(to_json({{employee_id: employee_id, date: date, scheduled_hours: scheduled_hours,
    actual_hours: actual_hours, tasks_completed: tasks_completed, tasks_assigned: tasks_assigned,
    demand_units: demand_units, capacity_units: capacity_units, department_code: department_code,
    location_code: location_code}}) AS VARCHAR) AS raw_data
FROM f WHERE rn = 1 AND (try_cast(date AS DATE) IS NULL
  OR coalesce(try_cast(scheduled_hours AS DOUBLE), 0.0) NOT BETWEEN 0 AND 24)""")
def split_invalid(spark, sf_dir):
    errors = cleaning.clean_workforce(feeds.raw_workforce(spark, sf_dir)).errors
    return errors.select("error_code", "row_index.l_orderkey", "row_index.l_linenumber", "raw_data")


@query("b21_alias_fallback", f"""
WITH {S.SIGNALS}
SELECT title, signal_date FROM signals""")
def alias_fallback(spark, sf_dir):
    feed = feeds.raw_market(spark, sf_dir).withColumnRenamed("signal_date", "date")
    return cleaning.clean_market_signals(feed).clean.select("title", "signal_date")


@query("b22_parse_flag", f"""
WITH {S.RAW_TICKETS}
SELECT ticket_id, escalated = 'true' AS escalated,
  CASE CAST(row_index % 8 AS INTEGER) WHEN 0 THEN TRUE WHEN 2 THEN TRUE WHEN 4 THEN TRUE
    ELSE FALSE END AS absent
FROM raw_tickets""")
def parse_flag(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("True", " no", "1", "FALSE", "yes", "0", "", "maybe")])
    word = F.element_at(words, (F.col("row_index") % 8 + 1).cast("int"))
    return feeds.raw_tickets(spark, sf_dir).select(
        "ticket_id", C.parse_flag(F.col("escalated")).alias("escalated"),
        C.parse_flag(word).alias("absent"))


@query("b23_truncate_int", f"""
WITH {S.RAW_MARKET}
SELECT title, CAST(trunc(CAST(value AS DOUBLE)) AS INTEGER) AS value FROM raw_market""")
def truncate_int(spark, sf_dir):
    return feeds.raw_market(spark, sf_dir).select("title", C.truncate_int(F.col("value")).alias("value"))


@query("b24_blank_to_null", f"""
WITH {S.RAW_MARKET}
SELECT nullif(tags, '') AS tags, count(*) AS n FROM raw_market GROUP BY ALL""")
def blank_to_null(spark, sf_dir):
    tags = C.blank_to_null(F.col("tags")).alias("tags")
    return feeds.raw_market(spark, sf_dir).groupBy(tags).agg(F.count("*").alias("n"))


# --- whole-feed cleaners ----------------------------------------------------------------
_HOUR_COLUMNS = ["employee_id", "date", "scheduled_hours", "actual_hours", "overtime_hours", "absent",
                 "absence_reason", "tasks_completed", "tasks_assigned", "utilization_rate",
                 "demand_units", "capacity_units", "department_code", "location_code"]


@query("b30_clean_workforce", f"WITH {S.HOURS} SELECT {', '.join(_HOUR_COLUMNS)} FROM hours")
def clean_workforce(spark, sf_dir):
    return cleaning.clean_workforce(feeds.raw_workforce(spark, sf_dir)).clean.select(*_HOUR_COLUMNS)


_TICKET_COLUMNS = ["ticket_id", "category", "priority", "status", "department_code", "channel",
                   "sentiment_score", "escalated", "sla_target_hours", "actual_resolution_hours",
                   "sla_breached"]


@query("b31_clean_tickets", f"""
WITH {S.TICKETS_DEDUPED}
SELECT {', '.join(_TICKET_COLUMNS)}, {_sql_text('created_at')}, {_sql_text('resolved_at')}
FROM tickets""")
def clean_tickets(spark, sf_dir):
    feed = feeds.raw_tickets(spark, sf_dir, repeated=True)
    return cleaning.clean_tickets(feed, AS_OF).clean.select(
        *_TICKET_COLUMNS, text("created_at"), text("resolved_at"))


_SIGNAL_COLUMNS = ["signal_date", "source", "title", "category", "industry", "region", "value",
                   "change_pct"]


@query("b32_clean_market_signals", f"WITH {S.SIGNALS} SELECT {', '.join(_SIGNAL_COLUMNS)} FROM signals")
def clean_market_signals(spark, sf_dir):
    return cleaning.clean_market_signals(feeds.raw_market(spark, sf_dir)).clean.select(
        *_SIGNAL_COLUMNS)


_EMPLOYEE_COLUMNS = ["employee_code", "full_name", "email", "role", "department_code", "hire_date",
                     "status", "hourly_rate"]


@query("b33_clean_employees", f"""
WITH {S.employees()}
SELECT {', '.join(_EMPLOYEE_COLUMNS)}, CAST(NULL AS VARCHAR) AS seniority_level FROM employees""")
def clean_employees(spark, sf_dir):
    return cleaning.clean_employees(feeds.raw_employees(spark, sf_dir)).select(
        *_EMPLOYEE_COLUMNS, "seniority_level")


_RECORD_COLUMNS = ["employee_code", "date", "scheduled_hours", "actual_hours", "overtime_hours",
                   "tasks_completed", "is_absent", "utilization_pct", "department_code"]


@query("b34_clean_operations_records", f"""
WITH {S.raw_workforce()}, r AS (
  SELECT *, row_number() OVER (PARTITION BY employee_id, date ORDER BY {S.ORDER_DESC}) AS rn
  FROM (SELECT {S.ORDER}, employee_id, try_cast(date AS DATE) AS date, department_code,
    greatest(coalesce(try_cast(scheduled_hours AS DOUBLE), 0.0), 0.0) AS scheduled_hours,
    greatest(coalesce(try_cast(actual_hours AS DOUBLE), 0.0), 0.0) AS actual_hours,
    CAST(tasks_completed AS INTEGER) AS tasks_completed FROM raw_workforce))
SELECT employee_id AS employee_code, date, scheduled_hours, actual_hours, 0.0::DOUBLE AS overtime_hours,
  tasks_completed, actual_hours = 0 AS is_absent,
  CASE WHEN scheduled_hours > 0 THEN round(actual_hours / scheduled_hours * 100, 1) END
    AS utilization_pct, department_code
FROM r WHERE rn = 1""")
def clean_operations_records(spark, sf_dir):
    feed = feeds.raw_operations_records(spark, sf_dir)
    return cleaning.clean_operations_records(feed).select(*_RECORD_COLUMNS)


@query("b35_clean_ticket_records", f"""
WITH {S.TICKET_RECORDS_DEDUPED}
SELECT ticket_number, category, priority, status, {_sql_text('created_at')},
  {_sql_text('resolved_at')}, resolution_minutes, sla_target_minutes, sla_breached
FROM ticket_records""")
def clean_ticket_records(spark, sf_dir):
    feed = feeds.raw_ticket_records(spark, sf_dir, repeated=True)
    valid = validate(feed, "ticket").valid
    return cleaning.clean_ticket_records(valid).select(
        "ticket_number", "category", "priority", "status", text("created_at"),
        text("resolved_at"), "resolution_minutes", "sla_target_minutes", "sla_breached")


@query("b36_clean_signal_records", f"""
WITH {S.RAW_MARKET}
SELECT try_cast(signal_date AS DATE) AS signal_date, lower(trim(category)) AS category, source, title,
  least(greatest(CAST(sentiment_score AS DOUBLE), -1.0), 1.0) AS sentiment_score,
  CAST(NULL AS DOUBLE) AS relevance_score,
  CASE WHEN tags <> '' THEN 'a|b|c' END AS tags FROM raw_market""")
def clean_signal_records(spark, sf_dir):
    return cleaning.clean_signal_records(feeds.raw_market(spark, sf_dir)).select(
        "signal_date", "category", "source", "title", "sentiment_score", "relevance_score",
        F.array_join("tags", "|").alias("tags"))


# --- row validation -----------------------------------------------------------------------
def _feed(spark, sf_dir, dataset):
    return {
        "employee": feeds.raw_employees, "operations": feeds.raw_operations_records,
        "ticket": feeds.raw_ticket_records, "market_signal": feeds.raw_market,
    }[dataset](spark, sf_dir)


# per dataset: CTE, name of the row, rule list (code, condition, detail) of the required columns
# and of the other checks, in the order in which they are reported
_EMPLOYEE_DETAIL = "'''email'' is not a valid email: ' || email"
CHECKS = {
    "employee": (S.RAW_EMPLOYEES, "raw_employees", "CAST(row_index AS VARCHAR)", [
        ("MISSING_FULL_NAME", "full_name = ''",
         "'Required field ''full_name'' is missing or empty'"),
    ], [
        ("INVALID_EMAIL_EMAIL", "email NOT LIKE '%@%'", _EMPLOYEE_DETAIL),
        ("INVALID_DATE_HIRE_DATE", "try_cast(hire_date AS DATE) IS NULL",
         "'''hire_date'' could not be parsed as a date: ' || hire_date"),
        ("NOT_NUMERIC_HOURLY_RATE", "try_cast(hourly_rate AS DOUBLE) IS NULL",
         "'''hourly_rate'' must be numeric, got ' || hourly_rate"),
        ("NEGATIVE_HOURLY_RATE", "try_cast(hourly_rate AS DOUBLE) < 0",
         "'''hourly_rate'' must be >= 0, got ' || try_cast(hourly_rate AS DOUBLE)"),
    ]),
    "operations": (S.raw_workforce(), "raw_workforce",
                   "concat_ws('/', l_orderkey, l_linenumber, l_partkey)", [], [
        ("INVALID_DATE_DATE", "date = 'bad-date'",
         "'''date'' could not be parsed as a date: ' || date"),
        ("NOT_NUMERIC_SCHEDULED_HOURS", "scheduled_hours = 'abc'",
         "'''scheduled_hours'' must be numeric, got abc'"),
        ("NEGATIVE_ACTUAL_HOURS", "actual_hours = '-1'",
         "'''actual_hours'' must be >= 0, got -1.0'"),
        ("OUT_OF_RANGE_SCHEDULED_HOURS", "scheduled_hours = '30'",
         "'''scheduled_hours'' must be between 0 and 24, got 30.0'"),
        ("OUT_OF_RANGE_ACTUAL_HOURS", "actual_hours = '-1'",
         "'''actual_hours'' must be between 0 and 24, got -1.0'"),
    ]),
    "ticket": (S.RAW_TICKETS, "raw_tickets", "CAST(row_index AS VARCHAR)", [], [
        ("INVALID_DATE_CREATED_AT", "created_at = 'bad-date'",
         "'''created_at'' could not be parsed as a date: ' || created_at"),
        ("INVALID_ENUM_PRIORITY", "priority = 'invalid_priority'",
         "'''priority'' must be one of [''low'', ''medium'', ''high'', ''critical''], got '''"
         " || priority || ''''"),
    ]),
    "market_signal": (S.RAW_MARKET, "raw_market", "CAST(row_index AS VARCHAR)", [], [
        ("INVALID_DATE_SIGNAL_DATE", "signal_date = 'n/a'",
         "'''signal_date'' could not be parsed as a date: ' || signal_date"),
        ("OUT_OF_RANGE_SENTIMENT_SCORE", "abs(CAST(sentiment_score AS DOUBLE)) > 1",
         "'''sentiment_score'' must be between -1.0 and 1.0, got ' || sentiment_score"),
        ("INVALID_ENUM_CATEGORY", "category = 'gossip'",
         "'''category'' must be one of [''competitor'', ''market'', ''regulatory'', ''hiring'', "
         "''technology'', ''sentiment''], got ''gossip'''"),
    ]),
}


def _validation_cte(dataset: str) -> str:
    cte, source, name, required, other = CHECKS[dataset]

    def listed(checks):
        if not checks:
            return "[]"
        return "[" + ", ".join(
            f"CASE WHEN {cond} THEN {{code: '{code}', detail: {detail}}} END"
            for code, cond, detail in checks) + "]"

    def present(items):
        return f"list_filter({items}, lambda x: x IS NOT NULL)" if items != "[]" else "[]"

    failed = present(listed(other))
    if required:
        first = present(listed(required))
        failed = f"CASE WHEN len({first}) > 0 THEN {first} ELSE {failed} END"
    return f"""{cte}, checked AS (SELECT *, {name} AS row_name, {failed} AS failed FROM {source})"""


def _row_name(dataset: str):
    if dataset == "operations":
        return F.concat_ws("/", "row_index.l_orderkey", "row_index.l_linenumber",
                           "row_index.l_partkey")
    return F.col("row_index").cast("string")


def _register_validation(dataset: str, ident: str):
    @query(f"c0_validate_{ident}", f"""
WITH {_validation_cte(dataset)}
SELECT row_name, array_to_string(list_transform(failed, lambda x: x.code), ',') AS error_codes,
  array_to_string(list_transform(failed, lambda x: x.detail), '; ') AS error_details
FROM checked WHERE len(failed) > 0""")
    def quarantined(spark, sf_dir):
        return validate(_feed(spark, sf_dir, dataset), dataset).quarantined.select(
            _row_name(dataset).alias("row_name"), F.array_join("error_codes", ",").alias("error_codes"),
            "error_details")

    @query(f"c0_totals_{ident}", f"""
WITH {_validation_cte(dataset)}
SELECT count(*) AS total_rows, count(*) FILTER (WHERE len(failed) = 0) AS valid_rows,
  count(*) FILTER (WHERE len(failed) > 0) AS quarantined_rows,
  count(*) FILTER (WHERE len(failed) > 0) / count(*) AS quarantine_rate
FROM checked""")
    def totals(spark, sf_dir):
        return validate(_feed(spark, sf_dir, dataset), dataset).totals()


for _dataset, _ident in [("employee", "employees"), ("operations", "operations"),
                         ("ticket", "tickets"), ("market_signal", "market_signals")]:
    _register_validation(_dataset, _ident)


def _register_rule(ident: str, dataset: str, prefix: str):
    """Rows that fail one kind of rule, by code."""
    @query(ident, f"""
WITH {_validation_cte(dataset)}
SELECT row_name, f.code AS code, f.detail AS detail
FROM (SELECT row_name, unnest(failed) AS f FROM checked) WHERE starts_with(f.code, '{prefix}')""")
    def rule(spark, sf_dir):
        tagged = validate(_feed(spark, sf_dir, dataset), dataset).tagged
        pairs = F.arrays_zip("error_codes", F.split("error_details", "; ").alias("detail"))
        return tagged.select(
            _row_name(dataset).alias("row_name"), F.explode(pairs).alias("f")
        ).select("row_name", F.col("f.error_codes").alias("code"), F.col("f.detail").alias("detail")
                 ).filter(F.col("code").startswith(prefix))


_register_rule("c1_missing_required", "employee", "MISSING_")
_register_rule("c3_invalid_email", "employee", "INVALID_EMAIL_")
_register_rule("c4_invalid_date", "market_signal", "INVALID_DATE_")
_register_rule("c5_not_numeric", "employee", "NOT_NUMERIC_")
_register_rule("c5_negative", "operations", "NEGATIVE_")
_register_rule("c6_out_of_range", "market_signal", "OUT_OF_RANGE_")
_register_rule("c7_invalid_enum", "ticket", "INVALID_ENUM_")


@query("c2_short_circuit", f"""
WITH {_validation_cte('employee')}
SELECT row_name, len(failed) AS reported,
  CAST(email NOT LIKE '%@%' AS INTEGER) + CAST(try_cast(hire_date AS DATE) IS NULL AS INTEGER)
    AS suppressed
FROM checked WHERE full_name = ''""")
def short_circuit(spark, sf_dir):
    tagged = validate(feeds.raw_employees(spark, sf_dir), "employee").tagged
    hidden = (~F.col("email").contains("@")).cast("int") + C.to_day(F.col("hire_date")).isNull().cast("int")
    return tagged.filter(F.col("full_name") == "").select(
        _row_name("employee").alias("row_name"), F.size("error_codes").alias("reported"),
        hidden.alias("suppressed"))


# --- dedup --------------------------------------------------------------------------------
@query("d1_dedup_hours_first", f"""
WITH {S.raw_workforce()}, r AS (SELECT *, row_number() OVER
  (PARTITION BY employee_id, date ORDER BY {S.ORDER}) AS rn FROM raw_workforce)
SELECT employee_id, date, actual_hours, l_orderkey FROM r WHERE rn = 1""")
def dedup_hours_first(spark, sf_dir):
    return dedup(feeds.raw_workforce(spark, sf_dir), ["employee_id", "date"]).select(
        "employee_id", "date", "actual_hours", "row_index.l_orderkey")


@query("d2_dedup_tickets_first", f"""
WITH {S.REPEATED_TICKETS}, r AS (SELECT *, row_number() OVER
  (PARTITION BY ticket_id ORDER BY row_index) AS rn FROM repeated_tickets)
SELECT ticket_id, status, row_index FROM r WHERE rn = 1""")
def dedup_tickets_first(spark, sf_dir):
    return dedup(feeds.raw_tickets(spark, sf_dir, repeated=True), ["ticket_id"]).select(
        "ticket_id", "status", "row_index")


@query("d3_dedup_employees_last", f"""
WITH {S.employees()}
SELECT employee_code, email, row_index FROM employees""")
def dedup_employees_last(spark, sf_dir):
    return cleaning.clean_employees(feeds.raw_employees(spark, sf_dir)).select(
        "employee_code", "email", "row_index")


@query("d4_dedup_operations_last", f"""
WITH {S.raw_workforce()}, r AS (SELECT *, row_number() OVER
  (PARTITION BY employee_id, try_cast(date AS DATE) ORDER BY {S.ORDER_DESC}) AS rn
  FROM raw_workforce)
SELECT employee_id AS employee_code, try_cast(date AS DATE) AS date, l_orderkey
FROM r WHERE rn = 1""")
def dedup_operations_last(spark, sf_dir):
    return cleaning.clean_operations_records(feeds.raw_operations_records(spark, sf_dir)).select(
        "employee_code", "date", "row_index.l_orderkey")


@query("d5_dedup_ticket_records_last", f"""
WITH {S.REPEATED_TICKETS}, r AS (SELECT *, row_number() OVER
  (PARTITION BY ticket_id ORDER BY row_index DESC) AS rn FROM repeated_tickets)
SELECT upper(ticket_id) AS ticket_number, lower(status) AS status, row_index FROM r WHERE rn = 1""")
def dedup_ticket_records_last(spark, sf_dir):
    feed = feeds.raw_ticket_records(spark, sf_dir, repeated=True)
    return cleaning.clean_ticket_records(feed).select("ticket_number", "status", "row_index")
