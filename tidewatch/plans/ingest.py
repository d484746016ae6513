"""Batch ingestion: feed -> validate or clean -> facts, quarantine, audit.

`commit` names a load. Every table skips a commit it already holds, so a load that failed half way is run
again under the same name and adds only what is missing; streams name their micro-batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.operators import cleaning, dimensions, loading, rollups
from tidewatch.operators.dedup import POINTER
from tidewatch.operators.validation import validate
from tidewatch.session import written
from tidewatch.sources import readers
from tidewatch.sources.landing import Landed
from tidewatch.sources.warehouse import DAYS, Warehouse

FACTS = {
    "workforce": ("fact_operations", loading.operations_facts),
    "tickets": ("fact_ticket", loading.ticket_facts),
    "market": ("fact_market_signal", loading.signal_facts),
}


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")


def add_days(store: Warehouse, rows: DataFrame, *columns: str) -> None:
    """Add the days of `columns` that the date dimension lacks."""
    days = rows.select(F.explode(F.array(*(F.col(c).cast("date") for c in columns))).alias("date"))
    store.append("dim_date", dimensions.build_dim_date(days, "date", store.read("dim_date")))


def load_dimensions(store: Warehouse, clean: DataFrame, source_type: str = "workforce") -> None:
    """Add the members that the rows mention first: days, departments, locations and employees."""
    days = {"workforce": ["date"], "tickets": ["created_at", "resolved_at"], "market": ["signal_date"]}
    add_days(store, clean, *days[source_type])
    if source_type == "market":
        return
    store.append("dim_department", dimensions.new_departments(clean, store.read("dim_department")))
    if source_type == "workforce":
        store.append("dim_location", dimensions.new_locations(clean, store.read("dim_location")))
        store.append("dim_employee", dimensions.new_employees(clean, store.read("dim_employee")))


def _add_days_of(store: Warehouse, table: str, commit: str) -> None:
    """The daily partial rows of what a load wrote, taken from its folder, so that a repeated load finds them too."""
    if table not in rollups.ROLLUPS:
        return
    daily, of = rollups.ROLLUPS[table]
    rows = store.loaded(table, commit)
    if rows is not None:
        store.append(daily, of(rows), commit)


def ingest_feed(
    store: Warehouse, feed: DataFrame, source_type: str, source_file: str, as_of: str,
    loaded_at: str, landed: Landed | None = None, commit: str | None = None,
) -> DataFrame:
    """Clean a feed and load it; returns the one-row summary.

    Three sinks read the tagged rows, so they are kept (spilling to disk) until all are
    written; a lost executor only means that its part is computed again. With `landed`, the rows' own files are
    named, the records that could not be read go to the errors, and the raw rows are known without a scan.
    """
    commit = commit or uuid.uuid4().hex
    tagged = readers.clean_feed(feed, source_type, as_of).tagged.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept = cleaning.Cleaned(tagged)
        table, layout = FACTS[source_type]
        file = F.col("source_file") if landed else source_file
        load_dimensions(store, kept.clean, source_type)
        if source_type == "tickets":
            existing, new = store.read(table), layout(kept.clean, file)
            new = new if existing is None else loading.insert_tickets_if_absent(new, existing)
            loaded = store.append(table, new, commit)
        else:
            loaded = store.append(table, kept.clean, commit, lambda rows: layout(rows, file))
        _add_days_of(store, table, commit)
        errors = loading.load_errors(kept.errors, source_file, source_type, loaded_at)
        if landed:
            bad = loading.malformed_errors(landed.malformed)
            errors = errors.unionByName(loading.load_errors(bad, source_file, source_type, loaded_at))
        store.append("staging_error", errors, commit)
        raw = landed.counts()[0] if landed else feed.count()
        summary = loading.ingest_summary(tagged, raw, loaded, source_type)
        if landed:
            summary = summary.withColumn("error_count", F.col("error_count") + landed.counts()[1])
        (row,) = summary.collect()  # one row of counts
        return store.spark.createDataFrame([row], summary.schema)
    finally:
        tagged.unpersist()


def ingest_files(
    store: Warehouse, path: str, source_type: str, as_of: str, loaded_at: str,
    multi_line: bool = True, commit: str | None = None,
) -> DataFrame:
    """`ingest_feed` of a file, or of a folder or pattern of CSV files, in order of their paths."""
    landed, route = readers.land_feed(store.spark, path, source_type, multi_line)
    name = path.rstrip("/").split("/")[-1]
    return ingest_feed(store, landed.rows, route, name, as_of, loaded_at, landed, commit)


# --- records --------------------------------------------------------------------------------
def _set_run(store: Warehouse, run: DataFrame, commit: str) -> None:
    store.merge("ingestion_run", run, "run_id", loading.run_states, commit)


def _started(store: Warehouse, run_id: str, source_name: str, dataset: str, at: str) -> DataFrame:
    row = (run_id, "csv", source_name, loading.target_table(dataset), "running", 0, 0, 0, 0.0, None)
    times = (datetime.fromisoformat(at), None)
    return store.spark.createDataFrame([row + times], loading.RUN_SCHEMA)


def _ended(run: DataFrame, message: str, at: str) -> DataFrame:
    """The run as failed: nothing counts as inserted, what was read is not known."""
    return run.withColumns({
        "status": F.lit("failed"), "error_message": F.lit(message),
        "completed_at": F.lit(at).cast("timestamp_ntz"),
    })


def ingest_records(
    store: Warehouse, feed: DataFrame, dataset: str, run_id: str, source_name: str,
    started_at: str, threshold: float = 0.1, landed: Landed | None = None,
    clock: Callable[[], str] = utc_now,
) -> DataFrame:
    """Validate records, quarantine the bad ones, upsert or insert the others, keep the audit row.

    The audit has one row for each run: `running` from the start, then success, partial or failed
    with its counts and `completed_at` (from `clock`). A run whose rows all fail ends before anything is
    loaded; any other error ends the run as failed, with its message, and is raised again. Records that could not
    be read count as read and as quarantined.
    """
    start = _started(store, run_id, source_name, dataset, started_at)
    _set_run(store, start, f"{run_id}/running")
    checked = validate(feed, dataset)
    checked.judged.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        (counts,) = checked.totals().collect()  # one row of counts
        malformed = landed.counts()[1] if landed else 0
        totals = _totals(store, counts["valid_rows"], counts["quarantined_rows"] + malformed)

        def record(inserted: int) -> DataFrame:
            rows = loading.run_record(
                totals, run_id, "csv", source_name, dataset, started_at, threshold, inserted, clock())
            return store.spark.createDataFrame(rows.collect(), loading.RUN_SCHEMA)  # one row

        ended = record(0)
        if ended.first()["status"] == "failed":
            _set_run(store, ended, f"{run_id}/ended")
            raise AllQuarantined(V.ALL_QUARANTINED)
        bad = checked.quarantined
        if landed:
            bad = bad.unionByName(loading.malformed_quarantine(landed.malformed), allowMissingColumns=True)
        store.append("quarantined_row", loading.quarantine_rows(bad, run_id, dataset, started_at),
                     f"{run_id}/quarantine")
        inserted = _load_records(store, checked.valid, dataset, run_id, started_at)
        audit = record(inserted)
        _set_run(store, audit, f"{run_id}/ended")
        return audit
    except AllQuarantined:
        raise
    except Exception as error:
        _set_run(store, _ended(start, str(error), clock()), f"{run_id}/ended")
        raise
    finally:
        checked.judged.unpersist()


class AllQuarantined(ValueError):
    """No row of a run is valid."""


def _totals(store: Warehouse, valid: int, bad: int) -> DataFrame:
    rate = bad / (valid + bad) if valid + bad else 0.0
    schema = "total_rows long, valid_rows long, quarantined_rows long, quarantine_rate double"
    return store.spark.createDataFrame([(valid + bad, valid, bad, rate)], schema)


def ingest_record_files(
    store: Warehouse, path: str, dataset: str, run_id: str, started_at: str, threshold: float = 0.1,
    multi_line: bool = True, clock: Callable[[], str] = utc_now,
) -> DataFrame:
    """`ingest_records` of a CSV file, folder or pattern; blanks stay blanks."""
    landed = readers.land_csv(store.spark, path, keep_blank=True, multi_line=multi_line)
    name = path.rstrip("/").split("/")[-1]
    return ingest_records(store, landed.rows, dataset, run_id, name, started_at, threshold, landed, clock)


def _with_days(store: Warehouse, records: DataFrame, column: str) -> DataFrame:
    """The date dimension, to which the load's new days have been added."""
    add_days(store, records, column)
    return store.read("dim_date")


def _held_days(store: Warehouse, table: str, records: DataFrame) -> DataFrame | None:
    """The rows of a fact between the first and the last day of `records`; its other months are not read."""
    if store.read(table) is None:
        return None
    first, last = records.agg(F.min(DAYS[table]), F.max(DAYS[table])).first()
    return None if first is None else store.read_between(table, first, last)


def _load_records(store: Warehouse, valid: DataFrame, dataset: str, run_id: str, at: str) -> int:
    """Load the valid rows; returns how many there are after dedup. Cleaned rows are written once and reread."""
    cleaner = {"employee": cleaning.clean_employees, "operations": cleaning.clean_operations_records,
               "ticket": cleaning.clean_ticket_records, "market_signal": cleaning.clean_signal_records}
    if dataset not in cleaner:
        raise ValueError(f"unknown dataset {dataset}")
    records = cleaner[dataset](valid).drop(*POINTER)
    commit = f"{run_id}/{dataset}"
    if dataset == "employee":
        records = written(records.withColumns({
            "employee_key": dimensions.member_key("employee_code"),
            "updated_at": F.lit(at).cast("timestamp_ntz"),
        }), "records")
        store.merge("dim_employee_record", records, "employee_code", loading.upsert_employees, commit)
        return records.count()
    if dataset == "operations":
        # dedup keeps a row of every day, so the days are those of the valid rows; without employees nothing
        # can be resolved, and the run ends before its rows are sorted and written
        given = C.normalize_columns(valid, "records")
        dim_date = _with_days(store, given.select(C.to_day(F.col("date")).alias("date")), "date")
        people = store.read("dim_employee_record")
        if people is None:
            raise ValueError("load the employee records before the operations records")
    records = written(records, "records")
    if dataset == "operations":
        rows = loading.resolve_operations(records, dim_date, people)
        existing = _held_days(store, "fact_operations_record", records)
        if existing is not None:
            rows = loading.insert_operations_ignore_conflicts(rows, existing)
        store.append("fact_operations_record", rows, commit)
    elif dataset == "ticket":
        store.merge("fact_ticket_record", records, "ticket_number", loading.upsert_ticket_records, commit)
    else:
        dim_date = _with_days(store, records, "signal_date")
        store.append("fact_signal_record", loading.resolve_signals(records, dim_date), commit)
    return records.count()


