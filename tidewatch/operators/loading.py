"""From cleaned rows to warehouse rows: fact layouts, insert-if-absent and upsert.

All of it is set-based: one join per table instead of a lookup per row. The functions
return the rows or the new state of a table; `tidewatch.sources.warehouse` writes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.functions import timeparts as T
from tidewatch.operators.dedup import FILE_ROW, ROW_INDEX, dedup
from tidewatch.operators.dimensions import absent_from, lookup, member_key


def _number(df: DataFrame, name: str):
    """Text as a number; one that a cleaner has parsed is not turned into text and parsed once more."""
    value = C.first_present(df, name)
    if dict(df.dtypes).get(name) == "double":
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))
    return C.coerce_numeric(value)


def _code(df: DataFrame, name: str, default: str):
    return F.coalesce(C.first_present(df, name), F.lit(default))


# --- fact layouts ----------------------------------------------------------------
def operations_facts(clean: DataFrame, source_file: str) -> DataFrame:
    department = _code(clean, "department_code", V.DEFAULT_DEPARTMENT)
    location = _code(clean, "location_code", V.DEFAULT_LOCATION)
    return clean.select(
        "date", T.date_id(F.col("date")).alias("date_id"),
        member_key("employee_id").alias("employee_key"), "employee_id",
        member_key(department).alias("department_key"), department.alias("department_code"),
        member_key(location).alias("location_key"), location.alias("location_code"),
        *[_number(clean, c).alias(c) for c in ("scheduled_hours", "actual_hours", "overtime_hours")],
        C.parse_flag(F.col("absent")).alias("absent"), "absence_reason",
        *[_number(clean, c).cast("int").alias(c)
          for c in ("tasks_completed", "tasks_assigned")],
        *[_number(clean, c).alias(c)
          for c in ("utilization_rate", "demand_units", "capacity_units")],
        F.lit(source_file).alias("source_file"),
    )


def ticket_facts(clean: DataFrame, source_file: str) -> DataFrame:
    created, resolved = F.col("created_at").cast("date"), F.col("resolved_at").cast("date")
    return clean.select(
        "ticket_id", created.alias("created_date"),
        T.date_id(created).alias("created_date_id"), T.date_id(resolved).alias("resolved_date_id"),
        member_key("department_code").alias("department_key"), "department_code", "category",
        C.blank_to_null(C.first_present(clean, "subcategory")).alias("subcategory"),
        "priority", "status", "created_at", "resolved_at", "sla_target_hours",
        "actual_resolution_hours", "sla_breached", "channel", "sentiment_score", "escalated",
        F.lit(source_file).alias("source_file"),
    )


def signal_facts(clean: DataFrame, source_file: str) -> DataFrame:
    texts = ("subcategory", "region", "industry", "value_label", "notes")
    return clean.select(
        T.date_id(F.col("signal_date")).alias("date_id"), "signal_date", "source", "category",
        "value", "change_pct",
        *[C.blank_to_null(C.first_present(clean, c)).alias(c) for c in texts],
        F.lit(source_file).alias("source_file"),
    )


# --- insert and upsert -------------------------------------------------------------
def insert_tickets_if_absent(new: DataFrame, existing: DataFrame) -> DataFrame:
    """The tickets to append: first one per id, and only ids the fact does not hold."""
    first = dedup(new, ["ticket_id"]) if ROW_INDEX in new.columns else new
    return absent_from(first, existing, ["ticket_id"])


def upsert(
    existing: DataFrame, incoming: DataFrame, key: str, update: Sequence[str]
) -> DataFrame:
    """New state of a table with unique keys.

    A known key keeps its row and takes the `update` columns of the incoming one; an unknown
    key is inserted whole. Both sides hold a key at most once (the cleaners see to that), so
    the full outer join spreads evenly whatever the data looks like. Rows with a NULL key meet none
    and stay whole on either side.
    """
    known = existing.withColumn("_held", F.lit(True)).alias("t")
    given = incoming.withColumn("_held", F.lit(True)).alias("s")
    joined = known.join(given, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    in_table, in_feed = F.col("t._held").isNotNull(), F.col("s._held").isNotNull()

    def value(c: str):
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}")
        if c in update:
            return F.when(in_feed, new).otherwise(old)
        return F.when(in_table, old).otherwise(new)

    return joined.select(*[value(c).alias(c) for c in existing.columns])


EMPLOYEE_UPDATES = ["full_name", "email", "role", "updated_at"]
TICKET_UPDATES = ["status", "resolved_at", "resolution_minutes", "sla_breached"]


def upsert_employees(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, "employee_code", EMPLOYEE_UPDATES)


def upsert_ticket_records(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, "ticket_number", TICKET_UPDATES)


def resolve_operations(records: DataFrame, dim_date: DataFrame, dim_employee: DataFrame) -> DataFrame:
    """Look up day, employee and the employee's department; NULL where there is none."""
    rows = lookup(records.drop("department_code"), dim_date, "date", "date", {"date_id": "date_id"})
    return lookup(rows, dim_employee, "employee_code", "employee_code",
                  {"employee_key": "employee_key", "department_code": "department_code"})


def insert_operations_ignore_conflicts(resolved: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append; a (employee, day) the fact already holds is left alone.

    Rows whose employee or day is unknown have a NULL key and never conflict.
    """
    return absent_from(resolved, existing, ["employee_key", "date_id"])


def resolve_signals(records: DataFrame, dim_date: DataFrame) -> DataFrame:
    return lookup(records, dim_date, "signal_date", "date", {"date_id": "date_id"})


# --- rows that did not make it --------------------------------------------------------
def _row_number(rows: DataFrame):
    """Number of the record in its file, from 1; without files the place in the feed stands in."""
    if FILE_ROW in rows.columns:
        return F.col(FILE_ROW).cast("string")
    numeric = dict(rows.dtypes)[ROW_INDEX] in ("bigint", "int")
    return (F.col(ROW_INDEX) + 1 if numeric else F.col(ROW_INDEX)).cast("string")


def load_errors(errors: DataFrame, source_file: str, source_type: str, at: str) -> DataFrame:
    """Cleaner errors in the layout of the staging table; a feed of files names the file of each row."""
    file = F.col("source_file") if "source_file" in errors.columns else F.lit(source_file)
    number = _row_number(errors) if FILE_ROW in errors.columns else F.col(ROW_INDEX).cast("string")
    return errors.select(
        file.alias("source_file"), F.lit(source_type).alias("source_type"),
        number.alias("row_number"), "raw_data",
        F.col("error_code").alias("error_type"), F.col("error_code").alias("error_message"),
        F.lit(at).cast("timestamp_ntz").alias("created_at"), F.lit(False).alias("resolved"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
    )


def malformed_errors(malformed: DataFrame) -> DataFrame:
    """Records that could not be read, as errors of a cleaner; raw_data is their original text."""
    return malformed.withColumn("error_code", F.lit(V.MALFORMED))


def malformed_quarantine(malformed: DataFrame) -> DataFrame:
    """Records that could not be read, as rows that failed validation."""
    return malformed.withColumns({
        "error_codes": F.array(F.lit(V.MALFORMED)), "error_details": F.lit(V.MALFORMED_DETAIL)})


def quarantine_rows(quarantined: DataFrame, run_id: str, dataset: str, at: str) -> DataFrame:
    """Failed rows in the layout of the quarantine table. Row numbers count from 1 in each file."""
    file = F.col("source_file") if "source_file" in quarantined.columns else F.lit(None).cast("string")
    return quarantined.select(
        F.lit(run_id).alias("run_id"), F.lit(dataset).alias("source_table"), file.alias("source_file"),
        _row_number(quarantined).alias("row_number"), "raw_data", "error_codes", "error_details",
        F.lit(at).cast("timestamp_ntz").alias("quarantined_at"), F.lit(False).alias("reviewed"),
    )


RUN_SCHEMA = (
    "run_id string, source_type string, source_name string, target_table string, status string, "
    "rows_read long, rows_inserted long, rows_quarantined long, quarantine_rate double, "
    "error_message string, started_at timestamp_ntz, completed_at timestamp_ntz"
)


def target_table(dataset: str) -> str:
    return "dim_employee" if dataset == "employee" else f"fact_{dataset}"


def run_status(rate, valid_rows, threshold: float):
    """success below the quarantine threshold, failed above it with no valid row, else partial."""
    failed = (rate > threshold) & (valid_rows == 0)
    return F.when(failed, "failed").when(rate < threshold, "success").otherwise("partial")


def run_record(
    totals: DataFrame, run_id: str, source_type: str, source_name: str, dataset: str, at: str,
    threshold: float, inserted: int | None = None, completed_at: str | None = None,
) -> DataFrame:
    """The audit row of a run that has come to its end.

    `inserted` is the number of rows the load took, that is of valid rows after dedup; without it, as
    before the load, the valid rows stand in.
    """
    rate = F.col("quarantine_rate")
    status = run_status(rate, F.col("valid_rows"), threshold)
    taken = F.col("valid_rows") if inserted is None else F.lit(inserted)
    return totals.select(
        F.lit(run_id).alias("run_id"), F.lit(source_type).alias("source_type"),
        F.lit(source_name).alias("source_name"), F.lit(target_table(dataset)).alias("target_table"),
        status.alias("status"), F.col("total_rows").cast("long").alias("rows_read"),
        F.when(status == "failed", 0).otherwise(taken).cast("long").alias("rows_inserted"),
        F.col("quarantined_rows").cast("long").alias("rows_quarantined"),
        F.round(rate, 4).alias("quarantine_rate"),
        F.when(status == "failed", V.ALL_QUARANTINED).alias("error_message"),
        F.lit(at).cast("timestamp_ntz").alias("started_at"),
        F.lit(completed_at).cast("timestamp_ntz").alias("completed_at"),
    )


def run_states(known: DataFrame, given: DataFrame) -> DataFrame:
    """The audit with the runs of `given` in their new state: one row for each run, whatever its state.

    Columns that only one side has stay, NULL in the other's rows.
    """
    return known.join(given.select("run_id"), "run_id", "left_anti").unionByName(
        given, allowMissingColumns=True)


# --- listings of the load tables -------------------------------------------------------
def list_errors(errors: DataFrame, resolved: bool = False, limit: int = 50) -> DataFrame:
    return errors.filter(F.col("resolved") == resolved).orderBy(
        F.desc("created_at"), "source_type", "row_number"
    ).limit(limit)


def list_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    if limit > 100:
        raise ValueError("limit must be at most 100")
    return runs.orderBy(F.desc("started_at"), "run_id").limit(limit)


def list_quarantine(
    rows: DataFrame, run_id: str | None = None, reviewed: bool | None = None, limit: int = 50
) -> DataFrame:
    if limit > 500:
        raise ValueError("limit must be at most 500")
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    if reviewed is not None:
        rows = rows.filter(F.col("reviewed") == reviewed)
    return rows.orderBy(F.desc("quarantined_at"), "run_id", "row_number").limit(limit)


def ingest_counts(cleaned_tagged: DataFrame) -> DataFrame:
    """clean_rows and error_count of a feed, from one pass over the tagged rows."""
    return cleaned_tagged.agg(
        F.count_if(F.col("error_code").isNull()).alias("clean_rows"),
        F.count_if(F.col("error_code").isNotNull()).alias("error_count"),
    )


def ingest_summary(cleaned_tagged: DataFrame, raw_rows: int, loaded_rows: int, source_type: str) -> DataFrame:
    """Raw, clean, loaded and rejected row counts of one feed, as one row.

    `raw_rows` and `loaded_rows` are what the landing read and the load wrote: a ticket that the fact
    already holds is clean, but not loaded.
    """
    return ingest_counts(cleaned_tagged).select(
        F.lit(source_type).alias("source_type"), F.lit(raw_rows).cast("long").alias("raw_rows"), "clean_rows",
        F.lit(loaded_rows).cast("long").alias("loaded_rows"), "error_count", F.lit("success").alias("status"),
    )
