"""DuckDB text of the feeds and of their cleaning, for use as CTEs of the oracles.

"""

from __future__ import annotations

AS_OF = "2024-01-31 00:00:00"

RAW_TICKETS = """
raw_tickets AS (
  SELECT event_id AS row_index,
    'TKT-' || event_id AS ticket_id,
    CASE WHEN event_id % 101 = 0 THEN 'bad-date'
         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_at,
    CASE WHEN event_id % 10 < 7
         THEN strftime(ts + to_seconds(CAST(floor(value * 1800) AS BIGINT)), '%Y-%m-%d %H:%M:%S')
         END AS resolved_at,
    event_type AS category,
    CASE WHEN event_id % 89 = 0 THEN 'invalid_priority' WHEN k % 10 < 3 THEN 'LOW'
         WHEN k % 10 < 7 THEN 'Medium' WHEN k % 10 < 9 THEN ' HIGH ' ELSE 'critical'
         END AS priority,
    CASE WHEN event_id % 10 < 4 THEN 'resolved' WHEN event_id % 10 < 7 THEN 'Closed'
         WHEN event_id % 10 < 8 THEN 'in_progress' ELSE 'open' END AS status,
    CASE user_id % 6 WHEN 0 THEN 'ENG' WHEN 1 THEN 'OPS' WHEN 2 THEN 'SUPPORT'
         WHEN 3 THEN 'SALES' WHEN 4 THEN 'HR' ELSE 'FINANCE' END AS department_code,
    CASE event_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'portal' WHEN 2 THEN 'phone' END AS channel,
    CAST((k - 50) / 50.0::DOUBLE AS VARCHAR) AS sentiment_score,
    CASE WHEN k >= 95 THEN 'true' ELSE 'false' END AS escalated,
    CAST(k AS VARCHAR) AS first_response_minutes
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""

REPEATED_TICKETS = RAW_TICKETS + """,
repeated_tickets AS (
  SELECT * FROM raw_tickets
  UNION ALL
  SELECT * REPLACE (row_index + 10000000 AS row_index, 'open' AS status)
  FROM raw_tickets WHERE row_index % 50 = 0
)"""


def _first(source: str, keys: str, order: str) -> str:
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1")


def _tagged_tickets(source: str) -> str:
    return f"""
tagged_tickets AS (
  SELECT * EXCLUDE (overdue),
    coalesce(actual_resolution_hours > sla_target_hours, FALSE) OR overdue AS sla_breached,
    CASE WHEN created_at IS NULL THEN 'invalid_created_at' END AS error_code
  FROM (
    SELECT *, coalesce(status IN ('open', 'in_progress')
        AND (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 3.6e9 > sla_target_hours,
        FALSE) AS overdue,
      (epoch_us(resolved_at) - epoch_us(created_at)) / 3.6e9 AS actual_resolution_hours
    FROM (
      SELECT *, CASE priority WHEN 'critical' THEN 4.0 WHEN 'high' THEN 8.0
          WHEN 'medium' THEN 24.0 ELSE 72.0 END::DOUBLE AS sla_target_hours
      FROM (
        SELECT row_index, ticket_id, category,
          try_cast(created_at AS TIMESTAMP) AS created_at,
          try_cast(resolved_at AS TIMESTAMP) AS resolved_at,
          CASE WHEN lower(trim(priority)) IN ('low', 'medium', 'high', 'critical')
               THEN lower(trim(priority)) ELSE 'medium' END AS priority,
          CASE WHEN lower(trim(status)) IN ('open', 'in_progress', 'resolved', 'closed')
               THEN lower(trim(status)) ELSE 'open' END AS status,
          coalesce(try_cast(sentiment_score AS DOUBLE), 0.0) AS sentiment_score,
          escalated = 'true' AS escalated,
          coalesce(channel, 'portal') AS channel,
          coalesce(department_code, 'UNKNOWN') AS department_code
        FROM ({_first(source, 'ticket_id', 'row_index')})
      )
    )
  )
)"""


_TICKETS = """,
tickets AS (
  SELECT *, CAST(created_at AS DATE) AS created_date FROM tagged_tickets WHERE error_code IS NULL
)"""

TICKETS = RAW_TICKETS + "," + _tagged_tickets("raw_tickets") + _TICKETS
TICKETS_DEDUPED = REPEATED_TICKETS + "," + _tagged_tickets("repeated_tickets") + _TICKETS


def _ticket_records(source: str) -> str:
    return f"""
ticket_records AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, CAST(created_at AS DATE) AS created_date,
      coalesce(resolution_minutes > sla_target_minutes, FALSE) AS sla_breached,
      row_number() OVER (PARTITION BY ticket_number ORDER BY row_index DESC) AS rn
    FROM (
      SELECT *,
        CAST(round_even((epoch_us(resolved_at) - epoch_us(created_at)) / 6e7, 0) AS BIGINT)
          AS resolution_minutes,
        CASE priority WHEN 'critical' THEN 240 WHEN 'high' THEN 480 WHEN 'medium' THEN 1440
          WHEN 'low' THEN 4320 END AS sla_target_minutes
      FROM (
        SELECT row_index, upper(trim(ticket_id)) AS ticket_number, lower(trim(category)) AS category,
          lower(trim(priority)) AS priority, lower(trim(status)) AS status, department_code,
          try_cast(created_at AS TIMESTAMP) AS created_at,
          try_cast(resolved_at AS TIMESTAMP) AS resolved_at,
          first_response_minutes, channel
        FROM {source}
        WHERE created_at <> 'bad-date' AND priority <> 'invalid_priority'
      )
    )
  ) WHERE rn = 1
)"""


TICKET_RECORDS = RAW_TICKETS + "," + _ticket_records("raw_tickets")
TICKET_RECORDS_DEDUPED = REPEATED_TICKETS + "," + _ticket_records("repeated_tickets")


def raw_workforce(shift_days: int = 0) -> str:
    return f"""
raw_workforce AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
    'EMP' || l_suppkey AS employee_id,
    CASE WHEN l_orderkey % 97 = 0 THEN 'bad-date'
         ELSE strftime(CAST(l_shipdate AS DATE) + {shift_days}, '%Y-%m-%d') END AS date,
    CASE WHEN l_partkey % 211 = 0 THEN 'abc' WHEN l_partkey % 199 = 0 THEN '30'
         ELSE CAST(s AS VARCHAR) END AS scheduled_hours,
    CASE WHEN l_quantity <= 2 THEN '0' WHEN l_quantity = 50 THEN '-1'
         ELSE CAST(round(s * (0.7::DOUBLE + l_quantity / 100), 2) AS VARCHAR) END AS actual_hours,
    CAST(CAST(floor(l_quantity / 5) AS BIGINT) AS VARCHAR) AS tasks_completed,
    '10' AS tasks_assigned,
    CAST(round(s * (0.75::DOUBLE + l_tax * 5), 2) AS VARCHAR) AS demand_units,
    CAST(s * 0.95::DOUBLE AS VARCHAR) AS capacity_units,
    CASE WHEN l_partkey % 23 <> 0 THEN 'D' || n_regionkey END AS department_code,
    n_name AS location_code
  FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 4.0 ELSE 8.0 END::DOUBLE AS s FROM lineitem)
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
)"""


ORDER = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"
ORDER_DESC = ", ".join(f"{c} DESC" for c in ORDER.split(", "))


def hours(shift_days: int = 0) -> str:
    """raw_workforce, tagged_hours (with error_code) and hours (clean rows)."""
    return raw_workforce(shift_days) + f""",
tagged_hours AS (
  SELECT *,
    CASE WHEN scheduled_hours > 0
         THEN least(greatest(actual_hours / scheduled_hours, 0.0), 2.0) ELSE 0.0 END
      AS utilization_rate,
    greatest(actual_hours - scheduled_hours, 0.0) AS overtime_hours,
    actual_hours = 0 AS absent,
    '' AS absence_reason,
    CASE WHEN date IS NULL THEN 'invalid_date'
         WHEN scheduled_hours < 0 OR scheduled_hours > 24 THEN 'hours_out_of_range' END AS error_code
  FROM (
    SELECT * REPLACE (
      try_cast(date AS DATE) AS date,
      coalesce(try_cast(scheduled_hours AS DOUBLE), 0.0) AS scheduled_hours,
      greatest(coalesce(try_cast(actual_hours AS DOUBLE), 0.0), 0.0) AS actual_hours,
      CAST(tasks_completed AS DOUBLE) AS tasks_completed,
      CAST(tasks_assigned AS DOUBLE) AS tasks_assigned,
      CAST(demand_units AS DOUBLE) AS demand_units,
      CAST(capacity_units AS DOUBLE) AS capacity_units,
      coalesce(department_code, 'UNKNOWN') AS department_code
    )
    FROM ({_first('raw_workforce', 'employee_id, date', ORDER)})
  )
),
hours AS (SELECT * EXCLUDE (error_code) FROM tagged_hours WHERE error_code IS NULL)"""


HOURS = hours()


def hour_records(shift_days: int = 0) -> str:
    """Hours of the record load: validated, then the last row per employee and day."""
    return raw_workforce(shift_days) + f""",
hour_records AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY employee_code, date ORDER BY {ORDER_DESC}) AS rn
    FROM (
      SELECT {ORDER}, upper(trim(employee_id)) AS employee_code, CAST(date AS DATE) AS date,
        CAST(scheduled_hours AS DOUBLE) AS scheduled_hours,
        CAST(actual_hours AS DOUBLE) AS actual_hours, 0.0::DOUBLE AS overtime_hours,
        CAST(tasks_completed AS INTEGER) AS tasks_completed,
        CAST(actual_hours AS DOUBLE) = 0 AS is_absent,
        CASE WHEN CAST(scheduled_hours AS DOUBLE) > 0 THEN
          round(CAST(actual_hours AS DOUBLE) / CAST(scheduled_hours AS DOUBLE) * 100, 1) END
          AS utilization_pct,
        department_code
      FROM raw_workforce
      WHERE date <> 'bad-date' AND scheduled_hours NOT IN ('abc', '30') AND actual_hours <> '-1'
    )
  ) WHERE rn = 1
)"""


RAW_MARKET = """
raw_market AS (
  SELECT o_orderkey AS row_index,
    CASE WHEN o_orderkey % 103 = 0 THEN 'n/a'
         ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS signal_date,
    'src_' || (o_custkey % 5) AS source,
    'Signal ' || o_orderkey AS title,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'competitor' WHEN '2-HIGH' THEN 'Market'
         WHEN '3-MEDIUM' THEN ' hiring ' WHEN '4-NOT SPECIFIED' THEN 'technology'
         ELSE 'gossip' END AS category,
    CASE WHEN o_custkey % 7 <> 0 THEN c_mktsegment END AS industry,
    r_name AS region,
    CAST(o_totalprice AS VARCHAR) AS value,
    CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS VARCHAR) AS change_pct,
    CAST((o_custkey % 31 - 15) / 10.0::DOUBLE AS VARCHAR) AS sentiment_score,
    CASE o_orderkey % 3 WHEN 0 THEN 'a, b,,c ' WHEN 1 THEN '' END AS tags
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

SIGNALS = RAW_MARKET + """,
tagged_signals AS (
  SELECT * REPLACE (
      try_cast(signal_date AS DATE) AS signal_date,
      coalesce(try_cast(value AS DOUBLE), 0.0) AS value,
      coalesce(try_cast(change_pct AS DOUBLE), 0.0) AS change_pct,
      coalesce(source, 'unknown') AS source,
      coalesce(category, 'general') AS category),
    CASE WHEN try_cast(signal_date AS DATE) IS NULL THEN 'invalid_signal_date' END AS error_code
  FROM raw_market
),
signals AS (SELECT * EXCLUDE (error_code) FROM tagged_signals WHERE error_code IS NULL)"""

RAW_EMPLOYEES = """
raw_employees AS (
  SELECT s_suppkey AS row_index,
    ' emp' || (s_suppkey % 80) AS employee_code,
    CASE WHEN s_suppkey % 17 = 0 THEN '' ELSE s_name END AS full_name,
    CASE WHEN s_suppkey % 13 = 0 THEN 'not-an-email'
         ELSE 'EMP' || s_suppkey || '@Company.com' END AS email,
    'Analyst' AS role,
    'D' || n_regionkey AS department_code,
    CASE WHEN s_suppkey % 19 = 0 THEN '31/31/2020'
         ELSE '20' || lpad(CAST(10 + s_suppkey % 14 AS VARCHAR), 2, '0') || '-0'
           || (1 + s_suppkey % 9) || '-15' END AS hire_date,
    CASE WHEN s_suppkey % 11 = 0 THEN 'abc' ELSE CAST(s_acctbal AS VARCHAR) END AS hourly_rate
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


def employees(source_filter: str = "TRUE") -> str:
    """Clean employee records of the rows that pass `source_filter`."""
    return RAW_EMPLOYEES + f""",
employees AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT row_index, upper(trim(employee_code)) AS employee_code, trim(full_name) AS full_name,
      lower(trim(email)) AS email, trim(role) AS role, trim(department_code) AS department_code,
      try_cast(hire_date AS DATE) AS hire_date, 'active' AS status,
      try_cast(hourly_rate AS DOUBLE) AS hourly_rate,
      row_number() OVER (PARTITION BY upper(trim(employee_code)) ORDER BY row_index DESC) AS rn
    FROM raw_employees WHERE {source_filter}
  ) WHERE rn = 1
)"""


# rows that pass the validator
VALID_EMPLOYEE = ("full_name <> '' AND email <> 'not-an-email' AND hire_date <> '31/31/2020' "
                  "AND hourly_rate <> 'abc' AND CAST(CASE WHEN hourly_rate = 'abc' THEN '0' "
                  "ELSE hourly_rate END AS DOUBLE) >= 0")


DEPARTMENTS = """
departments AS (
  SELECT 'D' || r_regionkey AS code, list_aggregate(list_transform(
      string_split(r_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS name
  FROM region
  UNION ALL SELECT 'UNKNOWN', 'Unknown'
)"""
