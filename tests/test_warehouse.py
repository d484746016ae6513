"""Manifests, merges of touched months, and loads that fail or run twice."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import loading
from tidewatch.plans import ingest
from tidewatch.sources.warehouse import Warehouse

AS_OF = "2024-01-20 00:00:00"
COLUMNS = ("ticket_number string, created_at timestamp_ntz, category string, status string, "
           "resolved_at timestamp_ntz, resolution_minutes long, sla_breached boolean")


@pytest.fixture()
def store(spark, tmp_path):
    return Warehouse(spark, str(tmp_path))


def records(spark, *rows):
    """(number, day, status) as ticket records."""
    full = [(n, f"{d} 10:00:00" if d else None, "c", s, None, None, False) for n, d, s in rows]
    raw = spark.createDataFrame(full, COLUMNS.replace("created_at timestamp_ntz", "created_at string"))
    return raw.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def merge(store, rows, commit=None):
    return store.merge("fact_ticket_record", rows, "ticket_number", loading.upsert_ticket_records, commit)


def states(store):
    return {r.ticket_number: r.status for r in store.read("fact_ticket_record").collect()}


def folders(store):
    return {e.folder for e in store._state("fact_ticket_record")[1] if e.folder}


@pytest.fixture()
def three_months(spark, store):
    merge(store, records(spark, *[(f"T{m}{d}", f"2024-0{m}-{d}", "open") for m in (1, 2, 3) for d in (10, 20)],
                         ("T0", None, "open")))
    return store


def test_only_touched_months_are_rewritten(spark, three_months):
    before = folders(three_months)
    assert len(before) == 4
    # T210 comes with another day, but is stored in February; T399 is new in March
    given = records(spark, ("T210", "2024-03-01", "closed"), ("T399", "2024-03-30", "open"))
    assert merge(three_months, given) == ["2024-02-01"]
    after = folders(three_months)
    kept = {f for f in before if "2024-02" not in f}
    assert kept < after and len(after - before) == 2 and len(before - after) == 1
    found = states(three_months)
    assert len(found) == 8 and found["T210"] == "closed" and found["T220"] == "open" and found["T399"] == "open"
    day = three_months.read("fact_ticket_record").filter("ticket_number = 'T210'").first().created_at
    assert day.month == 2  # a known ticket keeps its day
    assert merge(three_months, records(spark, ("T0", None, "closed"))) == ["__HIVE_DEFAULT_PARTITION__"]
    assert states(three_months)["T0"] == "closed" and len(states(three_months)) == 8


def test_a_merge_reads_only_keys_and_touched_months(spark, three_months, monkeypatch):
    plans = []

    def change(held, incoming):
        plans.append(held._jdf.queryExecution().toString())
        assert all("month=2024-02" in f for f in held.inputFiles())
        return loading.upsert_ticket_records(held, incoming)

    three_months.merge("fact_ticket_record", records(spark, ("T210", "2024-02-10", "closed")), "ticket_number", change)
    assert len(plans) == 1


@pytest.mark.parametrize("step", ["_add", "_write_manifest"])
def test_a_merge_that_fails_keeps_every_row(spark, three_months, monkeypatch, step):
    before = states(three_months)
    original = getattr(Warehouse, step)

    def lost(self, *args):
        if step == "_add":
            original(self, *args)  # the folder is written, the manifest is not
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, step, lost)
        with pytest.raises(RuntimeError, match="lost"):
            merge(three_months, records(spark, ("T210", "2024-02-10", "closed")))
    assert states(three_months) == before
    merge(three_months, records(spark, ("T210", "2024-02-10", "closed")))
    assert states(three_months) == before | {"T210": "closed"}


def test_commits_count_once_even_after_their_folders_are_gone(spark, three_months):
    merge(three_months, records(spark, ("T110", "2024-01-10", "closed")), "load-1")
    merge(three_months, records(spark, ("T110", "2024-01-10", "open")), "load-2")
    assert merge(three_months, records(spark, ("T110", "2024-01-10", "closed")), "load-1") == []
    assert states(three_months)["T110"] == "open"


def test_old_states_are_retained_and_then_dropped(spark, three_months):
    reader = three_months.read("fact_ticket_record")
    merge(three_months, records(spark, ("T110", "2024-01-10", "closed")))
    assert reader.filter("status = 'open'").count() == 7  # one state back can still be read
    merge(three_months, records(spark, ("T110", "2024-01-10", "open")))
    data = f"{three_months.root}/fact_ticket_record"
    assert len([n for n in os.listdir(f"{data}/manifest") if n.endswith(".json")]) == 2
    january = [d for d in os.listdir(f"{data}/data") if os.path.isdir(f"{data}/data/{d}/month=2024-01-01")]
    assert len(january) == 2


def test_two_writers_from_one_state(spark, store):
    store.append("people", spark.range(2))
    number, entries = store._state("people")
    new = store._add("people", spark.range(5, 6), number + 1, "b")
    store.append("people", spark.range(2, 3))
    with pytest.raises(RuntimeError, match="another load"):
        store._switch("people", number + 1, entries + new)
    assert sorted(r.id for r in store.read("people").collect()) == [0, 1, 2]


EMPLOYEE = ("employee_code string, full_name string, email string, role string, "
            "department_code string, hire_date string, hourly_rate string")


def test_run_states(frame, store, monkeypatch):
    rows = [("E1", "Ann", "a@b.co", "Dev", "ENG", "2020-01-01", "1"), ("e1 ", "Ann", "a@b.co", "Dev", "ENG", "2020-01-01", "2"),
            ("E2", "", "a@b.co", "Dev", "ENG", "2020-01-01", "1")]
    seen = []
    original = ingest._load_records

    def watched(*args):
        seen.extend(store.read("ingestion_run").collect())
        return original(*args)

    monkeypatch.setattr(ingest, "_load_records", watched)
    ingest.ingest_records(store, frame(EMPLOYEE, rows), "employee", "R1", "a.csv", AS_OF, clock=lambda: "2024-01-21 00:00:00")
    assert [(r.run_id, r.status, r.completed_at) for r in seen] == [("R1", "running", None)]
    (run,) = store.read("ingestion_run").collect()
    # three rows read, one bad, and of the two good ones the last stays
    assert (run.status, run.rows_read, run.rows_inserted, run.rows_quarantined) == ("partial", 3, 1, 1)
    assert str(run.completed_at) == "2024-01-21 00:00:00"


def test_a_run_that_breaks_is_recorded_as_failed(frame, store):
    schema = "employee_code string, date string, scheduled_hours string, actual_hours string"
    feed = frame(schema, [("E1", "2024-01-15", "8", "7")])
    with pytest.raises(ValueError, match="load the employee records"):
        ingest.ingest_records(store, feed, "operations", "R1", "o.csv", AS_OF)
    (run,) = store.read("ingestion_run").collect()
    assert run.status == "failed" and "employee records" in run.error_message and run.completed_at is not None
    ingest.ingest_records(store, frame(EMPLOYEE, [("E1", "Ann", "a@b.co", "Dev", "ENG", "2020-01-01", "1")]),
                          "employee", "R0", "a.csv", AS_OF)
    assert ingest.ingest_records(store, feed, "operations", "R2", "o.csv", AS_OF).first().status == "success"
    assert {r.run_id for r in loading.list_runs(store.read("ingestion_run")).collect()} == {"R0", "R1", "R2"}


def test_files_through_both_ingestions(spark, store, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    head = "ticket_id,created_at,category,priority,status\n"
    (folder / "a.csv").write_text(head + "T1,2024-01-15,c,low,open\nT2,2024-01-15,c,low,open,more\n")
    (folder / "b.csv").write_text(head + "T1,2024-01-16,c,low,closed\nT3,bad,c,low,open\nT4,2024-02-01,c,low,open\n")
    summary = ingest.ingest_files(store, str(folder / "*.csv"), "tickets", AS_OF, AS_OF, multi_line=False).first()
    assert (summary.raw_rows, summary.clean_rows, summary.loaded_rows, summary.error_count) == (5, 2, 2, 2)
    facts = {r.ticket_id: (r.status, r.source_file) for r in store.read("fact_ticket").collect()}
    assert facts == {"T1": ("open", "a.csv"), "T4": ("open", "b.csv")}
    errors = {(r.source_file, r.row_number, r.error_type) for r in store.read("staging_error").collect()}
    assert errors == {("a.csv", "2", "malformed_row"), ("b.csv", "2", "invalid_created_at")}
    for name in ("a.csv", "b.csv"):
        (folder / name).write_text((folder / name).read_text().replace("ticket_id", "ticket_number"))
    run = ingest.ingest_record_files(store, str(folder / "*.csv"), "ticket", "R1", AS_OF, multi_line=False).first()
    assert (run.status, run.rows_read, run.rows_inserted, run.rows_quarantined) == ("partial", 5, 2, 2)
    bad = {(r.source_file, r.row_number, r.error_codes[0]) for r in store.read("quarantined_row").collect()}
    assert bad == {("a.csv", "2", "malformed_row"), ("b.csv", "2", "INVALID_DATE_CREATED_AT")}
    last = store.read("fact_ticket_record").filter("ticket_number = 'T1'").first()
    assert last.status == "closed"  # records keep the last row, by the order of the files


def test_columns_of_small_tables_are_united(spark, store):
    """Small tables may gain columns; readers see their union."""
    store.append("ingestion_run", spark.createDataFrame([("a", 1)], "run_id string, x int"))
    store.append("ingestion_run", spark.createDataFrame([("b", 2)], "run_id string, y int"))
    assert {(r.run_id, r.x, r.y) for r in store.read("ingestion_run").collect()} == {("a", 1, None), ("b", None, 2)}
