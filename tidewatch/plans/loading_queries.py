"""Named queries: sources, dimensions, loads, joins and the streams."""

from __future__ import annotations

from contextlib import suppress
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.operators import cleaning, dimensions, loading
from tidewatch.operators.dedup import dedup
from tidewatch.operators.periods import label_periods, within
from tidewatch.operators.validation import validate
from tidewatch.plans import facts, ingest
from tidewatch.plans import feed_sql as S
from tidewatch.plans.cleaning_queries import _validation_cte, text
from tidewatch.plans.facts import AS_OF
from tidewatch.plans.registry import query
from tidewatch.session import work_dir, written
from tidewatch.sources import feeds, readers
from tidewatch.sources.warehouse import Warehouse, export_csv
from tidewatch.streaming import ingest as streams

_FEED_COLUMNS = ["ticket_id", "created_at", "resolved_at", "category", "priority", "status",
                 "department_code", "channel", "sentiment_score", "escalated"]


def _tickets_csv(spark, sf_dir, files: int | None = None, repeated: bool = True) -> str:
    """The ticket feed as CSV files in the shared folder, row order in column seq."""
    path = work_dir(spark, "tickets-csv")
    feed = feeds.raw_tickets(spark, sf_dir, repeated).select(
        F.col("row_index").alias("seq"), *_FEED_COLUMNS)
    if files:
        feed = feed.repartitionByRange(files, "seq").sortWithinPartitions("seq")
    export_csv(feed, path)
    return path


# --- sources ------------------------------------------------------------------------------
@query("a1_read_csv_feed", f"""
WITH {S.REPEATED_TICKETS} SELECT row_index AS seq, {', '.join(_FEED_COLUMNS)} FROM repeated_tickets""")
def read_csv_feed(spark, sf_dir):
    feed = readers.read_csv_feed(spark, _tickets_csv(spark, sf_dir))
    return feed.select(F.col("seq").cast("long").alias("seq"), *_FEED_COLUMNS)


@query("a2_read_csv_keep_blank", f"""
WITH {S.RAW_MARKET}
SELECT title, signal_date, coalesce(industry, '') AS industry, coalesce(tags, '') AS tags
FROM raw_market""")
def read_csv_keep_blank(spark, sf_dir):
    path = work_dir(spark, "market-csv")
    export_csv(feeds.raw_market(spark, sf_dir).select("title", "signal_date", "industry", "tags"), path)
    return readers.read_csv_feed(spark, path, keep_blank=True).select(
        "title", "signal_date", "industry", "tags")


@query("a3_read_json_feed", f"""
WITH {S.RAW_MARKET} SELECT title, signal_date, category, industry, region, value, change_pct, tags
FROM raw_market""")
def read_json_feed(spark, sf_dir):
    """All four envelopes, 50 signals to a document, one document per line."""
    names = ["title", "signal_date", "category", "industry", "region", "value", "change_pct", "tags"]
    rows = feeds.raw_market(spark, sf_dir).select(
        F.struct(*names).alias("r"), F.floor(F.col("row_index") / 50).alias("doc"))
    docs = rows.groupBy("doc").agg(F.collect_list("r").alias("rs"))
    kind = F.col("doc") % 4
    line = F.when(kind == 0, F.to_json(F.struct(F.col("rs").alias("signals")))).when(
        kind == 1, F.to_json(F.struct(F.col("rs").alias("data")))).when(
        kind == 2, F.to_json("rs"))
    enveloped = docs.filter(kind < 3).select(line.alias("value"))
    single = rows.filter(kind == 3).select(F.to_json("r").alias("value"))
    path = work_dir(spark, "market-json")
    enveloped.unionByName(single).write.text(path)
    return readers.read_json_feed(spark, path, multi_line=False).select(*names)


_BIG_K = "CASE WHEN row_index % 97 = 0 THEN ',extra' WHEN row_index % 89 = 0 THEN ',\"open' ELSE '' END"
_FOLDER_SQL = f"""
WITH {S.RAW_TICKETS}, placed AS (
  SELECT *, length(bin(row_index)) AS file, row_number() OVER (ORDER BY row_index) - 1 AS place,
    {_BIG_K} AS tail, row_number() OVER (PARTITION BY length(bin(row_index)) ORDER BY row_index) AS file_row
  FROM raw_tickets)"""


def _tickets_folder(spark, sf_dir) -> str:
    """The ticket feed in files of very unequal size, as lines without a column that gives their order.

    Every 97th line has a field too many, every 89th one an open quote.
    """
    feed = feeds.raw_tickets(spark, sf_dir)
    blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    line = F.concat(F.to_csv(F.struct(*_FEED_COLUMNS), blanks), F.expr(_BIG_K))
    file = F.format_string("%03d", F.length(F.bin("row_index")))
    lines = feed.select(file.alias("file"), F.col("row_index").alias("at"), line.alias("value"))
    header = lines.select("file").distinct().select(
        "file", F.lit(-1).cast("long").alias("at"), F.lit(",".join(_FEED_COLUMNS)).alias("value"))
    path = work_dir(spark, "tickets-folder")
    lines.unionByName(header).repartition("file").sortWithinPartitions("file", "at").select(
        "file", "value").write.partitionBy("file").text(path)
    return f"{path}/file=*"


@query("a1_read_csv_folder", f"""{_FOLDER_SQL}
SELECT place AS row_index, file_row, {', '.join(_FEED_COLUMNS)} FROM placed WHERE tail = ''""")
def read_csv_folder(spark, sf_dir):
    """Feed order and row numbers over files and splits, from their places alone."""
    feed = readers.read_csv_feed(spark, _tickets_folder(spark, sf_dir), multi_line=False)
    return feed.select("row_index", "file_row", *_FEED_COLUMNS)


@query("d1_first_row_of_folder", f"""{_FOLDER_SQL}
SELECT department_code, status, min(place) AS row_index,
  first(ticket_id ORDER BY place) AS ticket_id FROM placed WHERE tail = '' GROUP BY ALL""")
def first_row_of_folder(spark, sf_dir):
    """The first row of each key, first by the order of the files."""
    feed = readers.read_csv_feed(spark, _tickets_folder(spark, sf_dir), multi_line=False)
    return dedup(feed, ["department_code", "status"]).select(
        "department_code", "status", "row_index", "ticket_id")


def _line_sql() -> str:
    return " || ',' || ".join(f"coalesce({c}, '')" for c in _FEED_COLUMNS)


@query("a13_malformed_rows", f"""{_FOLDER_SQL}
SELECT 'RUN1' AS run_id, CAST(file_row AS VARCHAR) AS row_number, {_line_sql()} || tail AS raw_data,
  'malformed_row' AS error_codes FROM placed WHERE tail <> ''""")
def malformed_rows(spark, sf_dir):
    """Records that cannot be read are quarantined with their text, through the ingestion of a folder."""
    store = Warehouse(spark, work_dir(spark, "warehouse"))
    landed = readers.land_csv(spark, _tickets_folder(spark, sf_dir), keep_blank=True, multi_line=False)
    feed = landed.rows.withColumnRenamed("ticket_id", "ticket_number")
    ingest.ingest_records(store, feed, "ticket", "RUN1", "tickets", AS_OF, landed=landed, clock=_clock)
    bad = store.read("quarantined_row").filter(F.array_contains("error_codes", V.MALFORMED))
    return bad.select("run_id", "row_number", "raw_data", F.array_join("error_codes", ",").alias("error_codes"))


@query("a12_ingest_folder", f"""{_FOLDER_SQL}
SELECT CAST(file_row AS VARCHAR) AS row_number, {_line_sql()} || tail AS raw_line, 'malformed_row' AS error_type
FROM placed WHERE tail <> ''
UNION ALL
SELECT CAST(file_row AS VARCHAR), NULL, 'invalid_created_at' FROM placed
WHERE tail = '' AND try_cast(created_at AS TIMESTAMP) IS NULL""")
def ingest_folder(spark, sf_dir):
    """Errors of a folder that goes through `ingest_files`: broken lines and rows without a valid date."""
    store = Warehouse(spark, work_dir(spark, "warehouse"))
    path = _tickets_folder(spark, sf_dir)
    landed = readers.land_csv(spark, path, multi_line=False)
    ingest.ingest_feed(store, landed.rows, "tickets", "folder", AS_OF, AS_OF, landed)
    broken = F.col("error_type") == V.MALFORMED
    return store.read("staging_error").select(
        "row_number", F.when(broken, F.col("raw_data")).alias("raw_line"), "error_type")


@query("a3_json_documents", f"""
WITH {S.RAW_MARKET}
SELECT title, signal_date, category, 'ok' AS state FROM raw_market
UNION ALL
SELECT DISTINCT NULL, NULL, NULL, '[{{"document": ' || row_index // 20000 FROM raw_market""")
def json_documents(spark, sf_dir):
    """Whole files as documents, each beside one that is cut off; what cannot be read keeps its text."""
    names = ["title", "signal_date", "category"]
    rows = feeds.raw_market(spark, sf_dir).select(
        F.struct(*names).alias("r"), F.floor(F.col("row_index") / 20000).alias("doc"))
    good = rows.groupBy("doc").agg(F.to_json(F.struct(F.collect_list("r").alias("signals"))).alias("value"))
    cut = rows.select("doc").distinct().select(
        (F.col("doc") + 1_000_000).alias("doc"), F.concat(F.lit('[{"document": '), "doc").alias("value"))
    path = work_dir(spark, "documents-json")
    good.unionByName(cut).repartition("doc").write.partitionBy("doc").text(path)
    landed = readers.land_json(spark, f"{path}/doc=*", names)
    read = landed.rows.select(*names, F.lit("ok").alias("state"))
    broken = landed.malformed.select(
        *[F.lit(None).cast("string").alias(n) for n in names], F.btrim("raw_data", F.lit("\n")).alias("state"))
    return read.unionByName(broken)


# --- dimensions ---------------------------------------------------------------------------
@query("e1_build_dim_date", f"""
WITH {S.raw_workforce()}, d AS (
  SELECT DISTINCT CAST(date AS DATE) AS date FROM raw_workforce WHERE date <> 'bad-date')
SELECT date, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_id, year(date) AS year,
  quarter(date) AS quarter, month(date) AS month, monthname(date) AS month_name,
  CAST(strftime(date, '%W') AS INTEGER) AS week_of_year, isodow(date) - 1 AS day_of_week,
  dayname(date) AS day_name, isodow(date) >= 6 AS is_weekend, FALSE AS is_holiday,
  CASE WHEN month(date) >= 4 THEN year(date) ELSE year(date) - 1 END AS fiscal_year,
  CASE WHEN month(date) >= 4 THEN (month(date) - 4) // 3 + 1 ELSE 4 END AS fiscal_quarter
FROM d""")
def build_dim_date(spark, sf_dir):
    days = feeds.raw_workforce(spark, sf_dir).select(C.to_day(F.col("date")).alias("date"))
    return dimensions.build_dim_date(days, "date")


@query("e2_new_departments", f"""
WITH {S.HOURS}
SELECT DISTINCT department_code AS code,
  CASE WHEN department_code = 'UNKNOWN' THEN 'Unknown' ELSE department_code END AS name
FROM hours WHERE department_code NOT IN ('D0', 'D2', 'D4')""")
def new_departments(spark, sf_dir):
    known = facts.departments(spark, sf_dir).filter(F.col("code").isin("D0", "D2", "D4"))
    return dimensions.new_departments(facts.hour_facts(spark, sf_dir), known).select("code", "name")


@query("e3_new_locations", f"""
WITH {S.HOURS}
SELECT DISTINCT location_code AS code, 'Nation_' || string_split(location_code, '_')[2] AS city,
  'Canada' AS country FROM hours""")
def new_locations(spark, sf_dir):
    return dimensions.new_locations(facts.hour_facts(spark, sf_dir)).select("code", "city", "country")


@query("e4_new_employees", f"""
WITH {S.HOURS}, f AS (SELECT *, row_number() OVER
  (PARTITION BY employee_id ORDER BY {S.ORDER}) AS rn FROM hours)
SELECT employee_id, 'Unknown' AS first_name, 'Employee' AS last_name, 'Staff' AS role,
  lower(employee_id) || '@company.com' AS email, 'mid' AS level, 'full-time' AS employment_type,
  department_code, location_code, TRUE AS is_active
FROM f WHERE rn = 1 AND CAST(substr(employee_id, 4) AS INTEGER) % 2 = 1""")
def new_employees(spark, sf_dir):
    known = feeds.table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").selectExpr(
        "'EMP' || s_suppkey as employee_id")
    return dimensions.new_employees(facts.hour_facts(spark, sf_dir), known).drop(
        "employee_key", "department_key", "location_key")


def _known_employees(spark, sf_dir):
    return facts.employees(spark, sf_dir).withColumn(
        "employee_key", dimensions.member_key("employee_code"))


def _known_days(spark, sf_dir):
    """All days but the 31sts, so that lookups also miss."""
    days = feeds.table(spark, sf_dir, "lineitem").filter("day(l_shipdate) <> 31")
    return dimensions.build_dim_date(days, "l_shipdate")


_RESOLVED_SQL = f"""
WITH {S.hour_records()}, {S.employees(S.VALID_EMPLOYEE)},
days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE day(l_shipdate) <> 31),
resolved AS (
  SELECT r.employee_code, r.date, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_id,
    e.employee_code IS NOT NULL AS known_employee, e.department_code, utilization_pct, is_absent
  FROM hour_records r LEFT JOIN days ON r.date = day
  LEFT JOIN employees e ON r.employee_code = e.employee_code)"""


@query("e5_lookup_members", _RESOLVED_SQL + " SELECT * FROM resolved")
def lookup_members(spark, sf_dir):
    resolved = loading.resolve_operations(
        facts.hour_records(spark, sf_dir), _known_days(spark, sf_dir), _known_employees(spark, sf_dir))
    return resolved.select(
        "employee_code", "date", "date_id", F.col("employee_key").isNotNull().alias("known_employee"),
        "department_code", "utilization_pct", "is_absent")


# --- loads --------------------------------------------------------------------------------
@query("a5_append_operations", f"""
WITH {S.HOURS}
SELECT date, 2 * count(*) AS rows, CAST(2 * sum(tasks_completed) AS BIGINT) AS tasks_completed,
  2 * count(*) FILTER (WHERE absent) AS absences, count(DISTINCT employee_id) AS employees
FROM hours GROUP BY date""")
def append_operations(spark, sf_dir):
    """A feed loaded twice, in two loads, is in the fact twice."""
    store = Warehouse(spark, work_dir(spark, "warehouse"))
    for name in ("one.csv", "two.csv"):
        ingest.ingest_feed(store, feeds.raw_workforce(spark, sf_dir), "workforce", name, AS_OF, AS_OF)
    return store.read("fact_operations").groupBy("date").agg(
        F.count("*").alias("rows"), F.sum("tasks_completed").alias("tasks_completed"),
        F.count_if("absent").alias("absences"), F.count_distinct("employee_id").alias("employees"))


@query("a6_insert_tickets_if_absent", f"""
WITH {S.TICKETS_DEDUPED}
SELECT ticket_id, created_date, status, department_code FROM tickets WHERE row_index % 2 = 1""")
def insert_tickets_if_absent(spark, sf_dir):
    new = loading.ticket_facts(facts.ticket_facts(spark, sf_dir, repeated=True), "feed.csv")
    known = feeds.table(spark, sf_dir, "events").filter("event_id % 2 = 0").selectExpr(
        "'TKT-' || event_id as ticket_id")
    return loading.insert_tickets_if_absent(new, known).select(
        "ticket_id", "created_date", "status", "department_code")


@query("a6_ticket_dimensions", f"""
WITH {S.TICKETS_DEDUPED}, days AS (
  SELECT created_date AS day FROM tickets
  UNION SELECT CAST(resolved_at AS DATE) FROM tickets WHERE resolved_at IS NOT NULL)
SELECT 'dim_date' AS name, count(DISTINCT day) AS rows FROM days
UNION ALL SELECT 'dim_department', count(DISTINCT coalesce(department_code, 'UNKNOWN')) FROM tickets
UNION ALL SELECT 'fact_ticket', count(*) FROM tickets
UNION ALL SELECT 'unknown members', 0""")
def ticket_dimensions(spark, sf_dir):
    """Two loads of tickets add each day and department once, and every fact finds its members."""
    store = Warehouse(spark, work_dir(spark, "warehouse"))
    feed = feeds.raw_tickets(spark, sf_dir, repeated=True)
    for name, rows in (("even.csv", feed.filter("row_index % 2 = 0")), ("all.csv", feed)):
        ingest.ingest_feed(store, rows, "tickets", name, AS_OF, AS_OF)
    fact, days = store.read("fact_ticket"), store.read("dim_date").select("date_id")
    departments = store.read("dim_department").select("department_key")
    lost = fact.join(days, F.col("created_date_id") == F.col("date_id"), "left_anti").select("ticket_id")
    lost = lost.unionByName(fact.filter("resolved_at is not null").join(
        days, F.col("resolved_date_id") == F.col("date_id"), "left_anti").select("ticket_id"))
    lost = lost.unionByName(fact.join(departments, "department_key", "left_anti").select("ticket_id"))
    sizes = [("dim_date", days), ("dim_department", departments), ("fact_ticket", fact), ("unknown members", lost)]
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in sizes]
    return reduce(DataFrame.unionByName, counts)


@query("a7_append_market_signals", f"""
WITH {S.SIGNALS}
SELECT signal_date, CAST(strftime(signal_date, '%Y%m%d') AS INTEGER) AS date_id, source, category,
  region, industry, value, change_pct, unnest(['one.json', 'two.json']) AS source_file FROM signals""")
def append_market_signals(spark, sf_dir):
    """Two loads are appended one after the other; their days join the date dimension."""
    store = Warehouse(spark, work_dir(spark, "warehouse"))
    for name in ("one.json", "two.json"):
        ingest.ingest_feed(store, feeds.raw_market(spark, sf_dir), "market", name, AS_OF, AS_OF)
    days = store.read("dim_date").select("date_id")
    return store.read("fact_market_signal").join(days, "date_id", "left_semi").select(
        "signal_date", "date_id", "source", "category", "region", "industry", "value", "change_pct", "source_file")


_EMPLOYEE_STATE = ["employee_code", "full_name", "email", "role", "department_code", "status"]


@query("a8_upsert_employees", f"""
WITH {S.employees(S.VALID_EMPLOYEE)}
SELECT employee_code, CASE WHEN even THEN 'New ' || full_name ELSE full_name END AS full_name,
  email, CASE WHEN even THEN 'Lead' ELSE role END AS role, department_code,
  CASE WHEN even THEN 'active' ELSE 'new' END AS status, even AS updated
FROM (SELECT *, CAST(substr(employee_code, 4) AS INTEGER) % 2 = 0 AS even FROM employees)""")
def upsert_employees(spark, sf_dir):
    """Even codes are known: they take name, email and role, and keep their status."""
    people = facts.employees(spark, sf_dir).withColumn("updated_at", F.lit(False))
    even = F.substring("employee_code", 4, 10).cast("long") % 2 == 0
    incoming = people.withColumns({
        "full_name": F.when(even, F.concat(F.lit("New "), "full_name")).otherwise(F.col("full_name")),
        "role": F.when(even, "Lead").otherwise(F.col("role")),
        "status": F.lit("new"), "updated_at": even,
    })
    state = loading.upsert_employees(people.filter(even), incoming)
    return state.select(*_EMPLOYEE_STATE, F.col("updated_at").alias("updated"))


@query("a9_insert_operations_ignore_conflicts", _RESOLVED_SQL + """
SELECT employee_code, date, date_id, known_employee, department_code FROM resolved
WHERE NOT (known_employee AND date_id IS NOT NULL AND day(date) <= 10)""")
def insert_operations_ignore_conflicts(spark, sf_dir):
    """The fact already holds the first ten days of every month."""
    resolved = loading.resolve_operations(
        facts.hour_records(spark, sf_dir), _known_days(spark, sf_dir), _known_employees(spark, sf_dir))
    existing = resolved.filter(F.dayofmonth("date") <= 10)
    return loading.insert_operations_ignore_conflicts(resolved, existing).select(
        "employee_code", "date", "date_id", F.col("employee_key").isNotNull().alias("known_employee"),
        "department_code")


@query("a10_upsert_tickets", f"""
WITH {S.TICKET_RECORDS}
SELECT ticket_number, category, priority,
  CASE WHEN row_index % 2 = 0 THEN 'closed' ELSE status END AS status,
  CASE WHEN row_index % 2 = 0 THEN 0 ELSE resolution_minutes END AS resolution_minutes,
  sla_breached AND row_index % 2 = 1 AS sla_breached
FROM ticket_records""")
def upsert_tickets(spark, sf_dir):
    """Even tickets are known and come again as closed, under another category."""
    records = facts.ticket_records(spark, sf_dir)
    even = F.col("row_index") % 2 == 0
    incoming = records.withColumns({
        "status": F.when(even, "closed").otherwise(F.col("status")),
        "category": F.when(even, "other").otherwise(F.col("category")),
        "resolution_minutes": F.when(even, 0).otherwise(F.col("resolution_minutes")),
        "sla_breached": F.col("sla_breached") & ~even,
    })
    return loading.upsert_ticket_records(records.filter(even), incoming).select(
        "ticket_number", "category", "priority", "status", "resolution_minutes", "sla_breached")


@query("a10_upsert_tickets_stored", f"""
WITH {S.TICKET_RECORDS}
SELECT ticket_number, CASE WHEN known THEN category ELSE 'other' END AS category,
  CASE WHEN late THEN 'closed' ELSE status END AS status, resolution_minutes
FROM (
  SELECT *, row_index % 2 = 0 AS known, created_date >= DATE '2024-01-20' OR row_index % 2 = 1 AS late
  FROM ticket_records)""")
def upsert_tickets_stored(spark, sf_dir):
    """Two loads into a warehouse: even tickets, then the odd ones and those since the 20th, closed, as 'other'."""
    store = Warehouse(spark, work_dir(spark, "warehouse"))
    records = facts.ticket_records(spark, sf_dir)
    even = F.col("row_index") % 2 == 0
    store.merge("fact_ticket_record", written(records.filter(even), "records"), "ticket_number",
                loading.upsert_ticket_records, "one")
    late = records.filter((F.col("created_date") >= F.lit("2024-01-20").cast("date")) | ~even)
    incoming = written(late.withColumns({"status": F.lit("closed"), "category": F.lit("other")}), "records")
    store.merge("fact_ticket_record", incoming, "ticket_number", loading.upsert_ticket_records, "two")
    return store.read("fact_ticket_record").select("ticket_number", "category", "status", "resolution_minutes")


@query("a11_insert_market_signals", f"""
WITH {S.RAW_MARKET}, s AS (
  SELECT try_cast(signal_date AS DATE) AS signal_date, lower(trim(category)) AS category, source, title
  FROM raw_market WHERE signal_date <> 'n/a' AND category <> 'gossip'
  AND abs(CAST(sentiment_score AS DOUBLE)) <= 1)
SELECT *, CAST(strftime(signal_date, '%Y%m%d') AS INTEGER) AS date_id, unnest([1, 2]) AS load FROM s""")
def insert_market_signals(spark, sf_dir):
    """Two runs insert the same signals twice; the days they mention first are added before the lookup."""
    store = Warehouse(spark, work_dir(spark, "warehouse"))
    for run in ("RUN1", "RUN2"):
        ingest.ingest_records(store, feeds.raw_market(spark, sf_dir), "market_signal", run, "f.csv", AS_OF,
                              threshold=0.5, clock=_clock)
    rows = store.read("fact_signal_record").withColumn(
        "load", F.row_number().over(Window.partitionBy("title").orderBy("title")))
    return rows.select("signal_date", "category", "source", "title", "date_id", "load")


def _errors_sql(extra: str) -> str:
    return f"""
WITH {S.TICKETS_DEDUPED}, {S.SIGNALS},
errors AS (
  SELECT 'tickets' AS source_type, CAST(row_index AS VARCHAR) AS row_number,
    error_code AS error_type, '2024-02-01 00:00:00' AS created_at FROM tagged_tickets
  WHERE error_code IS NOT NULL
  UNION ALL
  SELECT 'market', CAST(row_index AS VARCHAR), error_code, '2024-02-02 00:00:00' FROM tagged_signals
  WHERE error_code IS NOT NULL)
SELECT * FROM errors {extra}"""


def _errors(spark, sf_dir):
    tickets = cleaning.clean_tickets(feeds.raw_tickets(spark, sf_dir, repeated=True), AS_OF).errors
    market = cleaning.clean_market_signals(feeds.raw_market(spark, sf_dir)).errors
    both = loading.load_errors(tickets, "t.csv", "tickets", "2024-02-01 00:00:00").unionByName(
        loading.load_errors(market, "m.json", "market", "2024-02-02 00:00:00"))
    return both


_ERROR_COLUMNS = ["source_type", "row_number", "error_type"]


@query("a12_load_errors", _errors_sql(""))
def load_errors(spark, sf_dir):
    return _errors(spark, sf_dir).select(*_ERROR_COLUMNS, text("created_at"))


@query("a13_write_quarantine", f"""
WITH {_validation_cte('ticket')}
SELECT 'RUN1' AS run_id, 'ticket' AS source_table, CAST(row_index + 1 AS VARCHAR) AS row_number,
  array_to_string(list_transform(failed, lambda x: x.code), ',') AS error_codes,
  array_to_string(list_transform(failed, lambda x: x.detail), '; ') AS error_details,
  FALSE AS reviewed FROM checked WHERE len(failed) > 0""")
def write_quarantine(spark, sf_dir):
    store = Warehouse(spark, work_dir(spark, "warehouse"))
    bad = validate(feeds.raw_ticket_records(spark, sf_dir), "ticket").quarantined
    store.append("quarantined_row", loading.quarantine_rows(bad, "RUN1", "ticket", AS_OF))
    return store.read("quarantined_row").select(
        "run_id", "source_table", "row_number", F.array_join("error_codes", ",").alias("error_codes"),
        "error_details", "reviewed")


_DATASETS = [("employee", feeds.raw_employees), ("market_signal", feeds.raw_market),
             ("operations", feeds.raw_operations_records), ("ticket", feeds.raw_ticket_records)]


#: Distinct keys of the valid rows: what is left after dedup.
_KEYS = {"employee": "count(DISTINCT upper(trim(employee_code)))",
         "operations": "count(DISTINCT (upper(trim(employee_id)), date))",
         "ticket": "count(DISTINCT upper(trim(ticket_id)))", "market_signal": "count(*)"}


def _runs_sql(order: str) -> str:
    parts = ["""
SELECT 'RUN0' AS run_id, 'fact_operations' AS target_table, 0 AS rows_read, 0 AS rows_inserted,
  0 AS rows_quarantined, 0.0::DOUBLE AS quarantine_rate, 'failed' AS status,
  'load the employee records before the operations records' AS error_message,
  '2024-01-31 00:00:00' AS started_at, '2024-02-01 00:00:00' AS completed_at"""]
    for i, (dataset, _) in enumerate(_DATASETS, 1):
        parts.append(f"""
SELECT 'RUN{i}', '{'dim_employee' if dataset == 'employee' else 'fact_' + dataset}', count(*),
  {_KEYS[dataset]} FILTER (WHERE len(failed) = 0), count(*) FILTER (WHERE len(failed) > 0),
  round(count(*) FILTER (WHERE len(failed) > 0) / count(*), 4),
  CASE WHEN count(*) FILTER (WHERE len(failed) > 0) / count(*) < 0.05 THEN 'success' ELSE 'partial' END,
  NULL, '2024-02-0{i} 00:00:00', '2024-02-01 00:00:00'
FROM (WITH {_validation_cte(dataset)} SELECT * FROM checked)""")
    parts.append("""
SELECT 'RUN5', 'dim_employee', count(*), 0, count(*), 1.0, 'failed',
  '100% quarantine rate — aborting. Check schema.', '2024-02-05 00:00:00', '2024-02-01 00:00:00'
FROM supplier WHERE s_suppkey % 17 = 0""")
    return " UNION ALL ".join(parts) + order


_RUN_COLUMNS = ["run_id", "target_table", "rows_read", "rows_inserted", "rows_quarantined",
                "quarantine_rate", "status", "error_message"]


def _clock() -> str:
    return "2024-02-01 00:00:00"


def _runs(spark, sf_dir):
    """Runs through the record ingestion: one that stops with an error, one for each dataset, one without a valid row."""
    store = Warehouse(spark, work_dir(spark, "warehouse"))

    def load(run, dataset, feed, at):
        ingest.ingest_records(store, feed, dataset, run, "f.csv", at, threshold=0.05, clock=_clock)

    with suppress(ValueError):  # hours before any employee
        load("RUN0", "operations", feeds.raw_operations_records(spark, sf_dir), AS_OF)
    for i, (dataset, feed) in enumerate(_DATASETS, 1):
        load(f"RUN{i}", dataset, feed(spark, sf_dir), f"2024-02-0{i} 00:00:00")
    with suppress(ValueError):  # no name at all
        load("RUN5", "employee", feeds.raw_employees(spark, sf_dir).filter("full_name = ''"),
             "2024-02-05 00:00:00")
    return store.read("ingestion_run")


@query("a14_ingestion_runs", _runs_sql(""))
def ingestion_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select(*_RUN_COLUMNS, text("started_at"), text("completed_at"))


@query("a15_list_errors", _errors_sql("ORDER BY created_at DESC, source_type, row_number LIMIT 50"))
def list_errors(spark, sf_dir):
    return loading.list_errors(_errors(spark, sf_dir)).select(*_ERROR_COLUMNS, text("created_at"))


@query("a16_list_runs", f"SELECT * FROM ({_runs_sql('')}) ORDER BY run_id DESC LIMIT 3")
def list_runs(spark, sf_dir):
    runs = loading.list_runs(_runs(spark, sf_dir), limit=3)
    return runs.select(*_RUN_COLUMNS, text("started_at"), text("completed_at"))


@query("a17_list_quarantine", f"""
WITH {_validation_cte('ticket')}
SELECT 'RUN1' AS run_id, CAST(row_index + 1 AS VARCHAR) AS row_number FROM checked
WHERE len(failed) > 0 ORDER BY row_number LIMIT 100""")
def list_quarantine(spark, sf_dir):
    bad = validate(feeds.raw_ticket_records(spark, sf_dir), "ticket").quarantined
    rows = loading.quarantine_rows(bad, "RUN1", "ticket", AS_OF).unionByName(
        loading.quarantine_rows(bad, "RUN2", "ticket", AS_OF))
    return loading.list_quarantine(rows, run_id="RUN1", reviewed=False, limit=100).select(
        "run_id", "row_number")


@query("a18_export_csv", f"""
WITH {S.TICKETS}
SELECT priority, count(*) AS tickets, count(*) FILTER (WHERE sla_breached) AS breached
FROM tickets GROUP BY priority""")
def export_report(spark, sf_dir):
    report = facts.ticket_facts(spark, sf_dir).groupBy("priority").agg(
        F.count("*").alias("tickets"), F.count_if("sla_breached").alias("breached"))
    path = work_dir(spark, "export")
    export_csv(report, path)
    return spark.read.option("header", True).schema(
        "priority string, tickets long, breached long").csv(path)


def _summary_sql(load: str, condition: str, new: str) -> str:
    return f"""
SELECT '{load}' AS load, 'tickets' AS source_type,
  (SELECT count(*) FROM repeated_tickets WHERE {condition}) AS raw_rows,
  count(*) FILTER (WHERE error_code IS NULL) AS clean_rows,
  count(*) FILTER (WHERE error_code IS NULL AND {new}) AS loaded_rows,
  count(*) FILTER (WHERE error_code IS NOT NULL) AS error_count, 'success' AS status
FROM tagged_tickets WHERE {condition}"""


@query("a19_ingest_summary", f"""
WITH {S.TICKETS_DEDUPED}
{_summary_sql('one', 'row_index % 2 = 0', 'TRUE')} UNION ALL {_summary_sql('two', 'TRUE', 'row_index % 2 = 1')}""")
def ingest_summary(spark, sf_dir):
    """Two loads of tickets: the second one finds the even ones in the fact, which are clean but not loaded."""
    store = Warehouse(spark, work_dir(spark, "warehouse"))
    feed = feeds.raw_tickets(spark, sf_dir, repeated=True)
    loads = [("one", feed.filter("row_index % 2 = 0")), ("two", feed)]
    found = [ingest.ingest_feed(store, rows, "tickets", name, AS_OF, AS_OF).withColumn("load", F.lit(name))
             for name, rows in loads]
    return found[0].unionByName(found[1])


# --- joins --------------------------------------------------------------------------------
@query("f1_fact_by_calendar", f"""
WITH {S.HOURS}
SELECT year(date) AS year, quarter(date) AS quarter, isodow(date) >= 6 AS is_weekend, count(*) AS rows
FROM hours WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY ALL""")
def fact_by_calendar(spark, sf_dir):
    """Calendar attributes come from the date itself: the fact stores it, so nothing is joined."""
    day = F.col("date")
    return within(facts.hour_facts(spark, sf_dir), "date", "1996-01-01", "1998-12-31").groupBy(
        F.year(day).alias("year"), F.quarter(day).alias("quarter"),
        (F.weekday(day) >= 5).alias("is_weekend")).agg(F.count("*").alias("rows"))


@query("f2_fact_department_inner", f"""
WITH {S.HOURS}, {S.DEPARTMENTS}
SELECT name, count(*) AS rows FROM hours JOIN departments ON department_code = code
WHERE code <> 'UNKNOWN' GROUP BY name""")
def fact_department_inner(spark, sf_dir):
    names = facts.departments(spark, sf_dir).filter(F.col("code") != "UNKNOWN")
    per = facts.hour_facts(spark, sf_dir).groupBy("department_code").agg(F.count("*").alias("rows"))
    return per.join(names, F.col("department_code") == F.col("code")).select("name", "rows")


@query("f3_fact_department_left", f"""
WITH {S.HOURS}, {S.DEPARTMENTS}
SELECT name, count(*) AS rows FROM hours
LEFT JOIN (SELECT * FROM departments WHERE code IN ('D1', 'D3')) ON department_code = code
GROUP BY name""")
def fact_department_left(spark, sf_dir):
    names = facts.departments(spark, sf_dir).filter(F.col("code").isin("D1", "D3"))
    per = facts.hour_facts(spark, sf_dir).groupBy("department_code").agg(F.count("*").alias("rows"))
    return per.join(names, F.col("department_code") == F.col("code"), "left").groupBy("name").agg(
        F.sum("rows").alias("rows"))


@query("f4_absent_members", f"""
WITH {S.HOURS}
SELECT DISTINCT employee_id FROM hours
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE 'EMP' || s_suppkey = employee_id AND s_nationkey < 15)""")
def absent_members(spark, sf_dir):
    known = feeds.table(spark, sf_dir, "supplier").filter("s_nationkey < 15").selectExpr(
        "'EMP' || s_suppkey as employee_id")
    seen = facts.hour_facts(spark, sf_dir).select("employee_id").distinct()
    return dimensions.absent_from(seen, known, ["employee_id"])


@query("f5_conflict_upsert", f"""
WITH {S.TICKET_RECORDS}
SELECT row_index % 3 = 0 AS was_known, CASE WHEN row_index % 3 = 0 THEN 'open' ELSE status END AS status,
  count(*) AS tickets FROM ticket_records GROUP BY ALL""")
def conflict_upsert(spark, sf_dir):
    records = facts.ticket_records(spark, sf_dir).select("ticket_number", "status", "row_index")
    known = F.col("row_index") % 3 == 0
    incoming = records.withColumn("status", F.when(known, "open").otherwise(F.col("status")))
    state = loading.upsert(records.filter(known), incoming, "ticket_number", ["status"])
    return state.groupBy(known.alias("was_known"), "status").agg(F.count("*").alias("tickets"))


@query("f6_current_and_prior", f"""
WITH {S.HOURS}
SELECT CASE WHEN date >= DATE '1998-01-01' THEN 'current' ELSE 'prior' END AS period,
  department_code, count(*) AS rows, count(DISTINCT employee_id) AS headcount
FROM hours WHERE date BETWEEN DATE '1998-01-01' - 90 AND DATE '1998-03-31' GROUP BY ALL""")
def current_and_prior(spark, sf_dir):
    rows = label_periods(facts.hour_facts(spark, sf_dir), "date", "1998-01-01", "1998-03-31", "equal")
    return rows.groupBy("period", "department_code").agg(
        F.count("*").alias("rows"), F.count_distinct("employee_id").alias("headcount"))


# --- streams ------------------------------------------------------------------------------
_FACT_COLUMNS = ["ticket_id", "created_date", "priority", "status", "department_code",
                 "actual_resolution_hours", "sla_breached", "channel"]


def _run_ticket_stream(spark, sf_dir, repeated: bool) -> Warehouse:
    landing = _tickets_csv(spark, sf_dir, files=4, repeated=repeated)
    store = Warehouse(spark, work_dir(spark, "stream-warehouse"))
    stream = streams.landing_stream(spark, landing, ["seq", *_FEED_COLUMNS], files_per_batch=1)
    streams.start_feed_stream(stream, store, "tickets", AS_OF, work_dir(spark, "stream-state"),
                              order_by="seq").awaitTermination()
    return store


@query("s1_stream_ingest", f"""
WITH {S.TICKETS}
SELECT {', '.join(_FACT_COLUMNS)} FROM tickets""")
def stream_ingest(spark, sf_dir):
    return _run_ticket_stream(spark, sf_dir, repeated=False).read("fact_ticket").select(*_FACT_COLUMNS)


@query("s1_stream_records", f"""
WITH {_validation_cte('ticket')}
SELECT 'facts' AS name, count(DISTINCT ticket_id) AS rows FROM checked WHERE len(failed) = 0
UNION ALL SELECT 'quarantined', count(*) FROM checked WHERE len(failed) > 0
UNION ALL SELECT 'runs', 4
UNION ALL SELECT 'rows read', count(*) FROM checked""")
def stream_records(spark, sf_dir):
    """Validated records in four micro-batches: facts, quarantine and one completed run for each batch."""
    store = Warehouse(spark, work_dir(spark, "stream-warehouse"))
    names = ["ticket_number", *_FEED_COLUMNS[1:], "first_response_minutes"]
    path = work_dir(spark, "records-csv")
    feed = feeds.raw_ticket_records(spark, sf_dir).select(F.col("row_index").alias("seq"), *names)
    export_csv(feed.repartitionByRange(4, "seq").sortWithinPartitions("seq"), path)
    stream = streams.landing_stream(spark, path, ["seq", *names], files_per_batch=1)
    streams.start_record_stream(stream, store, "ticket", work_dir(spark, "stream-state"), clock=_clock,
                                order_by="seq").awaitTermination()
    runs = store.read("ingestion_run").filter("completed_at is not null")
    counts = [("facts", store.read("fact_ticket_record").agg(F.count("*"))),
              ("quarantined", store.read("quarantined_row").agg(F.count("*"))),
              ("runs", runs.agg(F.count("*"))), ("rows read", runs.agg(F.sum("rows_read")))]
    return reduce(DataFrame.unionByName, [
        df.toDF("rows").select(F.lit(n).alias("name"), "rows") for n, df in counts])


@query("s1_batch_stream_batch", f"""
WITH {S.TICKETS}
SELECT {', '.join(_FACT_COLUMNS)} FROM tickets""")
def batch_stream_batch(spark, sf_dir):
    """A batch, a stream and a batch again, into one table and one layout."""
    store = Warehouse(spark, work_dir(spark, "stream-warehouse"))
    feed = feeds.raw_tickets(spark, sf_dir)
    ingest.ingest_feed(store, feed.filter("row_index % 3 = 0"), "tickets", "one.csv", AS_OF, AS_OF)
    landing = work_dir(spark, "tickets-csv")
    export_csv(feed.filter("row_index % 3 < 2").select(F.col("row_index").alias("seq"), *_FEED_COLUMNS), landing)
    stream = streams.landing_stream(spark, landing, ["seq", *_FEED_COLUMNS])
    streams.start_feed_stream(stream, store, "tickets", AS_OF, work_dir(spark, "stream-state"),
                              order_by="seq").awaitTermination()
    ingest.ingest_feed(store, feed, "tickets", "two.csv", AS_OF, AS_OF)
    return store.read("fact_ticket").select(*_FACT_COLUMNS)


@query("s2_stream_dedup", f"""
WITH {S.TICKETS_DEDUPED}
SELECT count(*) AS facts, count(DISTINCT ticket_id) AS tickets, 4 AS batches,
  (SELECT count(*) FROM repeated_tickets) AS raw_rows FROM tickets""")
def stream_dedup(spark, sf_dir):
    """A ticket that arrives in two files is inserted once, from the batch that came first."""
    store = _run_ticket_stream(spark, sf_dir, repeated=True)
    loaded = store.read("fact_ticket").agg(
        F.count("*").alias("facts"), F.count_distinct("ticket_id").alias("tickets"),
        F.lit(0).alias("batches"), F.lit(0).alias("raw_rows"))
    audit = store.read("ingestion_run").agg(
        F.lit(0).alias("facts"), F.lit(0).alias("tickets"), F.count("*").alias("batches"),
        F.sum("raw_rows").alias("raw_rows"))
    return loaded.unionByName(audit).agg(
        *[F.sum(c).alias(c) for c in ("facts", "tickets", "batches", "raw_rows")])


@query("s2_first_tickets", f"""
WITH {S.TICKETS_DEDUPED} SELECT ticket_id, 1 AS copies FROM tickets""")
def first_tickets(spark, sf_dir):
    """Repeats within the delay are dropped by keyed state, over four micro-batches and without reading any history.

    Rows without a valid creation time have no place in event time and are left to the cleaner.
    """
    landing, out = _tickets_csv(spark, sf_dir, files=4), work_dir(spark, "first-tickets")
    stream = streams.landing_stream(spark, landing, ["seq", *_FEED_COLUMNS], files_per_batch=1)
    timed = stream.filter(C.to_moment(F.col("created_at")).isNotNull())
    streams.first_tickets(timed, "60 days").select("ticket_id").writeStream.format("parquet").option(
        "checkpointLocation", work_dir(spark, "first-state")).outputMode("append").trigger(
        availableNow=True).start(out).awaitTermination()
    return spark.read.schema("ticket_id string").parquet(out).groupBy("ticket_id").agg(
        F.count("*").alias("copies"))


@query("s3_stream_daily_volume", f"""
WITH {S.TICKETS}
SELECT created_date AS date, count(*) AS ticket_count,
  count(*) FILTER (WHERE priority = 'critical') AS critical_count
FROM tickets
GROUP BY created_date
HAVING created_date + 1 <= (SELECT max(created_at) FROM tickets) - INTERVAL 1 DAY""")
def stream_daily_volume(spark, sf_dir):
    """Days that closed; the last ones stay open until the watermark passes them."""
    landing, out = work_dir(spark, "ticket-facts"), work_dir(spark, "daily-volume")
    rows = facts.ticket_facts(spark, sf_dir).select(
        C.utc_instant(F.col("created_at")).alias("created_at"), "priority")
    rows.write.parquet(landing)
    stream = spark.readStream.schema(rows.schema).parquet(landing)
    streams.daily_ticket_volume(stream).writeStream.format("parquet").option(
        "path", out).option("checkpointLocation", work_dir(spark, "daily-state")
                            ).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("date date, ticket_count long, critical_count long").parquet(out)
