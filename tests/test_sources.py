import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import loading
from tidewatch.plans import ingest
from tidewatch.session import work_dir
from tidewatch.sources import readers
from tidewatch.sources.warehouse import Warehouse, export_csv

AS_OF = "2024-01-20 00:00:00"


@pytest.fixture()
def store(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "warehouse"))


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_missing_tokens_and_quotes(spark, tmp_path):
    path = write(tmp_path / "f.csv", 'a,b,c\n1,NA,"x ""y"""\n2,,"two\nlines"\n3,n/a,none\n')
    rows = readers.read_csv_feed(spark, path).orderBy("row_index").collect()
    assert [(r.a, r.b, r.c) for r in rows] == [
        ("1", None, 'x "y"'), ("2", None, "two\nlines"), ("3", None, "none")]
    assert rows[0].source_file == "f.csv" and [r.row_index for r in rows] == [0, 1, 2]


def test_csv_keep_blank(spark, tmp_path):
    path = write(tmp_path / "f.csv", "a,b\n1,NA\n2,\n")
    rows = readers.read_csv_feed(spark, path, keep_blank=True).orderBy("a").collect()
    assert [r.b for r in rows] == ["NA", ""]


@pytest.mark.parametrize("document, count", [
    ([{"signal_date": "2024-01-01", "value": 1}, {"signal_date": "2024-01-02", "value": 2.5}], 2),
    ({"signals": [{"signal_date": "2024-01-01"}]}, 1),
    ({"data": [{"date": "2024-01-01"}, {"date": "bad"}]}, 2),
    ({"signal_date": "2024-01-01", "category": "hiring"}, 1),
    ({"signals": []}, 0),
])
def test_json_envelopes(spark, tmp_path, document, count):
    path = write(tmp_path / "f.json", json.dumps(document, indent=1))
    rows = readers.read_json_feed(spark, path)
    assert rows.count() == count
    cleaned = readers.read_feed(spark, path, "tickets", AS_OF)  # JSON is always market signals
    assert cleaned.clean.count() + cleaned.errors.count() == count


def test_routes():
    assert readers.check_route("x/A.CSV", "tickets") == "tickets"
    assert readers.check_route("a.json", "workforce") == "market"
    with pytest.raises(ValueError, match="source_type"):
        readers.check_route("a.csv", "sales")
    with pytest.raises(ValueError, match="not allowed"):
        readers.check_route("a.xlsx", "tickets")


def test_export_keeps_blanks(spark, tmp_path):
    rows = spark.createDataFrame([(" a ", 'say "x"')], "a string, b string")
    export_csv(rows, str(tmp_path / "out"))
    back = readers.read_csv_feed(spark, str(tmp_path / "out")).first()
    assert (back.a, back.b) == (" a ", 'say "x"')


def test_work_dir_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = work_dir(spark, "x")
    assert base is None or path.startswith(base)
    assert path != work_dir(spark, "x")


TICKETS = "ticket_id string, created_at string, category string, priority string, status string"


def test_ticket_ingest_is_insert_if_absent_and_keeps_errors(frame, store):
    feed = frame(TICKETS, [("T1", "2024-01-15", "c", "low", "open"), ("T2", "bad", "c", "low", "open"),
                           ("T1", "2024-01-16", "c", "low", "open")])
    summary = ingest.ingest_feed(store, feed, "tickets", "f.csv", AS_OF, AS_OF).first()
    assert (summary.raw_rows, summary.clean_rows, summary.error_count) == (3, 1, 1)
    again = frame(TICKETS, [("T1", "2024-01-17", "c", "low", "closed"), ("T3", "2024-02-15", "c", "low", "open")])
    ingest.ingest_feed(store, again, "tickets", "g.csv", AS_OF, AS_OF)
    facts = {r.ticket_id: r for r in store.read("fact_ticket").collect()}
    assert set(facts) == {"T1", "T3"} and facts["T1"].status == "open"
    assert facts["T1"].created_date_id == 20240115
    assert store.read_between("fact_ticket", "2024-02-01", "2024-02-20").count() == 1
    errors = loading.list_errors(store.read("staging_error")).collect()
    assert [(e.source_file, e.error_type) for e in errors] == [("f.csv", "invalid_created_at")]
    assert '"ticket_id":"T2"' in errors[0].raw_data


def test_workforce_ingest_appends_and_builds_dimensions(frame, store):
    schema = ("employee_id string, date string, scheduled_hours string, actual_hours string, "
              "department_code string, role string")
    feed = frame(schema, [("E1", "2024-01-15", "8", "7", "ENG", "Dev"),
                          ("E1", "2024-01-16", "8", "8", "OPS", "Lead"),
                          ("E2", "2024-01-16", "8", "0", None, None)])
    for name in ("a.csv", "b.csv"):
        ingest.ingest_feed(store, feed, "workforce", name, AS_OF, AS_OF)
    assert store.read("fact_operations").count() == 6  # loading again duplicates
    assert store.read("dim_date").count() == 2 and store.read("dim_department").count() == 3
    people = {r.employee_id: r for r in store.read("dim_employee").collect()}
    assert people["E1"].role == "Dev" and people["E1"].department_code == "ENG"  # first seen wins
    assert people["E2"].role == "Staff" and people["E2"].email == "e2@company.com"
    assert people["E2"].location_code == "HQ"
    fact = store.read("fact_operations")
    dims = store.read("dim_department")
    assert fact.join(dims, "department_key").count() == 6


EMPLOYEE = ("employee_code string, full_name string, email string, role string, "
            "department_code string, hire_date string, hourly_rate string")


def test_employee_records_upsert(frame, store):
    first = frame(EMPLOYEE, [("E1", "Ann", "a@b.co", "Dev", "ENG", "2020-01-01", "10"),
                             ("E2", "Bob", "b@b.co", "Dev", "ENG", "2020-01-01", "10")])
    ingest.ingest_records(store, first, "employee", "R1", "a.csv", AS_OF)
    second = frame(EMPLOYEE, [("E2", "Bobby", "bb@b.co", "Lead", "OPS", "2021-01-01", "20"),
                              ("E3", "Cy", "c@b.co", "Dev", "HR", "2020-01-01", "x")])
    audit = ingest.ingest_records(store, second, "employee", "R2", "b.csv", AS_OF).first()
    assert (audit.status, audit.rows_read, audit.rows_inserted, audit.rows_quarantined) == (
        "partial", 2, 1, 1)
    people = {r.employee_code: r for r in store.read("dim_employee_record").collect()}
    assert set(people) == {"E1", "E2"}
    assert (people["E2"].full_name, people["E2"].role) == ("Bobby", "Lead")
    assert people["E2"].department_code == "ENG" and people["E2"].hourly_rate == 10.0
    (bad,) = loading.list_quarantine(store.read("quarantined_row"), run_id="R2").collect()
    assert bad.error_codes == ["NOT_NUMERIC_HOURLY_RATE"] and bad.row_number == "2"
    assert [r.run_id for r in loading.list_runs(store.read("ingestion_run")).collect()] == ["R1", "R2"]


def test_a_run_without_valid_rows_fails_before_loading(frame, store):
    feed = frame(EMPLOYEE, [("E1", "", "a@b.co", "Dev", "ENG", "2020-01-01", "10")])
    with pytest.raises(ValueError, match="quarantine rate"):
        ingest.ingest_records(store, feed, "employee", "R1", "a.csv", AS_OF)
    assert store.read("ingestion_run").first().status == "failed"
    assert store.read("dim_employee_record") is None


def test_operations_records_resolve_members_and_ignore_conflicts(frame, store):
    ingest.ingest_records(store, frame(EMPLOYEE, [
        ("E1", "Ann", "a@b.co", "Dev", "ENG", "2020-01-01", "10")]), "employee", "R1", "a.csv", AS_OF)
    schema = "employee_code string, date string, scheduled_hours string, actual_hours string"
    rows = [("e1", "2024-01-15", "8", "7"), ("e9", "2024-01-15", "8", "7")]
    for run in ("R2", "R3"):
        ingest.ingest_records(store, frame(schema, rows), "operations", run, "o.csv", AS_OF)
    fact = store.read("fact_operations_record")
    assert fact.filter("employee_code = 'E1'").count() == 1
    assert fact.filter("employee_code = 'E1'").first().department_code == "ENG"
    # an unknown employee has a NULL key, and NULLs never conflict
    assert fact.filter("employee_code = 'E9' and employee_key is null").count() == 2


def test_ticket_records_upsert_only_the_listed_columns(frame, store):
    schema = ("ticket_number string, created_at string, resolved_at string, category string, "
              "priority string, status string")
    ingest.ingest_records(store, frame(schema, [
        ("t1", "2024-01-15", "", "Tech", "low", "open")]), "ticket", "R1", "a.csv", AS_OF)
    ingest.ingest_records(store, frame(schema, [
        ("T1", "2024-01-15", "2024-01-20", "Other", "high", "closed")]), "ticket", "R2", "b.csv", AS_OF)
    (row,) = store.read("fact_ticket_record").collect()
    assert (row.status, row.category, row.priority) == ("closed", "tech", "low")
    assert row.resolution_minutes == 5 * 24 * 60 and row.sla_breached is True


def test_listing_limits(spark):
    with pytest.raises(ValueError):
        loading.list_runs(spark.range(1), limit=101)
    with pytest.raises(ValueError):
        loading.list_quarantine(spark.range(1), limit=501)


def test_failure_inside_quarantine_threshold(frame):
    totals = frame("total_rows long, valid_rows long, quarantined_rows long, quarantine_rate double",
                   [(100, 95, 5, 0.05)], index=False)
    run = loading.run_record(totals, "R", "csv", "f", "ticket", AS_OF, threshold=0.1).first()
    assert run.status == "success" and run.target_table == "fact_ticket" and run.error_message is None
    exact = totals.withColumn("quarantine_rate", F.lit(0.1))
    assert loading.run_record(exact, "R", "csv", "f", "ticket", AS_OF, 0.1).first().status == "partial"


def test_a_replacement_that_fails_keeps_the_old_state(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    store = Warehouse(spark, str(tmp_path))
    store.append("people", spark.range(3))
    store.replace("people", store.read("people").union(spark.range(10, 12)))
    assert store.read("people").count() == 5
    broken = store.read("people").select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.replace("people", broken)
    assert store.read("people").count() == 5
    store.replace("people", store.read("people").filter("id < 2"))
    store.append("people", spark.range(20, 21))
    assert sorted(r.id for r in store.read("people").collect()) == [0, 1, 20]


def test_upsert_keeps_rows_with_null_keys_whole(spark):
    from tidewatch.operators.loading import upsert

    old = spark.createDataFrame([(None, 1, 1), ("a", 1, 1)], "k string, v int, w int")
    new = spark.createDataFrame([(None, 2, 2), ("a", 2, 2)], "k string, v int, w int")
    rows = sorted(map(tuple, upsert(old, new, "k", ["v"]).collect()), key=str)
    assert rows == [("a", 2, 1), (None, 1, 1), (None, 2, 2)]
