import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import cleaning
from tidewatch.operators.dedup import dedup
from tidewatch.operators.validation import validate

AS_OF = "2024-01-20 00:00:00"
WORKFORCE = ("employee_id string, date string, scheduled_hours string, actual_hours string, "
             "overtime_hours string, department_code string")
WORKFORCE_ROWS = [
    ("EMP001", "2024-01-15", "8.0", "7.5", "0", "ENG"),
    ("EMP002", "2024-01-15", "8.0", "9.0", "1.0", "OPS"),
    ("EMP001", "2024-01-15", "8.0", "7.5", "0", "ENG"),
    ("EMP003", "bad-date", "8.0", "8.0", "0", "HR"),
]
TICKETS = ("ticket_id string, created_at string, resolved_at string, category string, "
           "priority string, status string")
TICKET_ROWS = [
    ("TKT-001", "2024-01-15 09:00:00", "2024-01-15 17:00:00", "technical", "HIGH", "resolved"),
    ("TKT-002", "2024-01-15 10:00:00", None, "billing", "medium", "open"),
    ("TKT-001", "2024-01-15 09:00:00", "2024-01-15 17:00:00", "technical", "HIGH", "resolved"),
    ("TKT-003", "2024-01-15 11:00:00", None, "onboarding", "invalid_priority", "in_progress"),
]


@pytest.fixture()
def workforce(frame):
    return cleaning.clean_workforce(frame(WORKFORCE, WORKFORCE_ROWS))


@pytest.fixture()
def tickets(frame):
    return cleaning.clean_tickets(frame(TICKETS, TICKET_ROWS), AS_OF)


def by(rows, key):
    return {r[key]: r for r in rows}


def test_workforce_duplicates_and_bad_dates(workforce):
    rows = workforce.clean.collect()
    assert sorted(r.employee_id for r in rows) == ["EMP001", "EMP002"]
    (error,) = workforce.errors.collect()
    assert error.error_code == "invalid_date" and error.row_index == 3
    assert json.loads(error.raw_data)["date"] == "bad-date"


def test_workforce_measures(workforce):
    rows = by(workforce.clean.collect(), "employee_id")
    assert rows["EMP001"].utilization_rate == pytest.approx(0.9375)
    assert rows["EMP002"].utilization_rate == pytest.approx(1.125)
    assert all(0 <= r.utilization_rate <= 2 for r in rows.values())
    assert rows["EMP001"].absence_reason == "" and rows["EMP001"].absent is False


def test_workforce_missing_columns(frame):
    with pytest.raises(ValueError, match="Missing required columns"):
        cleaning.clean_workforce(frame("employee_id string", [("EMP001",)]))


def test_workforce_coercion_ranges_and_defaults(frame):
    feed = frame("employee_id string, date string, scheduled_hours string, actual_hours string", [
        ("a", "2024-01-15", "abc", "8"), ("b", "2024-01-15", "30", "8"),
        ("c", "2024-01-15", "8", "-2"), ("d", "2024-01-15", "4", "20"), ("e", "2024-01-15", "-1", "1"),
    ])
    result = cleaning.clean_workforce(feed)
    rows = by(result.clean.collect(), "employee_id")
    assert set(rows) == {"a", "c", "d"}
    assert rows["a"].scheduled_hours == 0.0 and rows["a"].utilization_rate == 0.0
    assert rows["c"].actual_hours == 0.0 and rows["c"].absent is True
    assert rows["d"].utilization_rate == 2.0 and rows["d"].overtime_hours == 16.0
    assert {r.department_code for r in rows.values()} == {"UNKNOWN"}
    assert {r.error_code for r in result.errors.collect()} == {"hours_out_of_range"}


def test_defaults_reach_every_row(frame):
    """A default must not leave trailing rows NULL after bad rows were taken out."""
    rows = [(f"T{i}", "bad" if i < 3 else "2024-01-15", "x", "low", "open") for i in range(6)]
    feed = frame("ticket_id string, created_at string, category string, priority string, status string", rows)
    clean = cleaning.clean_tickets(feed, AS_OF).clean
    assert clean.count() == 3
    assert clean.filter("channel = 'portal' and department_code = 'UNKNOWN'").count() == 3
    assert clean.filter("resolved_at is null and sentiment_score = 0 and not escalated").count() == 3


def test_ticket_cleaning(tickets):
    rows = by(tickets.clean.collect(), "ticket_id")
    assert len(rows) == 3
    assert rows["TKT-001"].priority == "high" and rows["TKT-003"].priority == "medium"
    assert all(r.sla_target_hours > 0 for r in rows.values())
    assert rows["TKT-001"].actual_resolution_hours == pytest.approx(8.0)
    assert rows["TKT-001"].sla_breached is False  # 8 > 8 does not hold
    assert rows["TKT-002"].sla_breached is True and rows["TKT-002"].actual_resolution_hours is None


def test_open_tickets_are_overdue_as_of(frame):
    feed = frame(TICKETS, TICKET_ROWS)
    early = cleaning.clean_tickets(feed, "2024-01-15 12:00:00").clean
    assert early.filter("sla_breached").count() == 0


def test_market_signals(frame):
    feed = frame("date string, change_pct string, category string", [
        ("2024-01-15", "1.5", None), ("n/a", "2", "hiring"), ("2024-01-16", "x", "market")])
    result = cleaning.clean_market_signals(feed)
    rows = result.clean.orderBy("signal_date").collect()
    assert [(r.change_pct, r.value, r.source, r.category) for r in rows] == [
        (1.5, 0.0, "unknown", "general"), (0.0, 0.0, "unknown", "market")]
    assert [r.error_code for r in result.errors.collect()] == ["invalid_signal_date"]


def test_employee_records_keep_the_last(frame):
    feed = frame("`Employee Code` string, `Full-Name` string, email string, role string, "
                 "department_code string, hire_date string, hourly_rate string", [
                     (" emp1", " Ann ", "ANN@x.com", "Dev", "ENG", "2020-01-01", "10"),
                     ("EMP1", "Ann B", "b@x.com", "Dev", "ENG", "bad", "abc")])
    (row,) = cleaning.clean_employees(feed).collect()
    assert (row.employee_code, row.full_name, row.email) == ("EMP1", "Ann B", "b@x.com")
    assert row.hire_date is None and row.hourly_rate is None and row.status == "active"


def test_operations_records(frame):
    feed = frame("employee_code string, date string, scheduled_hours string, actual_hours string, "
                 "is_absent string, tasks_completed string", [
                     ("e1", "2024-01-15", "8", "6", "False", "3.9"),
                     ("e2", "2024-01-15", "0", "0", "False", None),
                     ("E1 ", "2024-01-15", "8", "20", "True", "1")])
    rows = by(cleaning.clean_operations_records(feed).collect(), "employee_code")
    assert rows["E1"].utilization_pct == 250.0 and rows["E1"].is_absent is True
    assert rows["E2"].utilization_pct is None and rows["E2"].is_absent is True
    assert rows["E2"].overtime_hours == 0.0 and rows["E2"].tasks_completed == 0


def test_signal_records(frame):
    feed = frame("signal_date string, category string, source string, title string, "
                 "sentiment_score string, tags string",
                 [("2024-01-15", " Hiring ", " s ", "t", "-7", "a, b,,c ")])
    (row,) = cleaning.clean_signal_records(feed).collect()
    assert (row.category, row.source, row.sentiment_score) == ("hiring", "s", -1.0)
    assert row.tags == ["a", "b", "c"] and row.relevance_score is None


def test_dedup_treats_null_keys_as_equal(frame):
    rows = frame("k string, v int", [(None, 1), (None, 2), ("a", 3)])
    assert {(r.k, r.v) for r in dedup(rows, ["k"]).collect()} == {(None, 1), ("a", 3)}
    assert {(r.k, r.v) for r in dedup(rows, ["k"], "last").collect()} == {(None, 2), ("a", 3)}


# --- validation -----------------------------------------------------------------------------
EMPLOYEE = ("employee_code string, full_name string, email string, role string, "
            "department_code string, hire_date string, hourly_rate string")


def codes(frame, dataset, schema, rows):
    tagged = validate(frame(schema, rows), dataset).tagged
    return [r.error_codes for r in tagged.orderBy("row_index").collect()]


def test_employee_rules(frame):
    good = ("E1", "Ann", "a@b.co", "Dev", "ENG", "2020-01-01", "10")
    rows = [good, ("E1", " ", "bad", "Dev", "ENG", "bad", "x"), (*good[:2], "bad", *good[3:]),
            (*good[:5], "31/31/2020", "abc"), (*good[:6], "-1"), (*good[:6], ""), (*good[:6], None)]
    assert codes(frame, "employee", EMPLOYEE, rows) == [
        [], ["MISSING_FULL_NAME"], ["INVALID_EMAIL_EMAIL"],
        ["INVALID_DATE_HIRE_DATE", "NOT_NUMERIC_HOURLY_RATE"], ["NEGATIVE_HOURLY_RATE"], [], []]


def test_operations_rules_report_both_codes(frame):
    schema = "employee_code string, date string, scheduled_hours string, actual_hours string"
    rows = [("E", "2024-01-15", "-1", "8"), ("E", "2024-01-15", "nan", "25"),
            ("E", "2024-01-15", "abc", "8")]
    assert codes(frame, "operations", schema, rows) == [
        ["NEGATIVE_SCHEDULED_HOURS", "OUT_OF_RANGE_SCHEDULED_HOURS"],
        ["OUT_OF_RANGE_SCHEDULED_HOURS", "OUT_OF_RANGE_ACTUAL_HOURS"],
        ["NOT_NUMERIC_SCHEDULED_HOURS"]]


def test_absent_required_column_is_a_constant_error(frame):
    assert codes(frame, "market_signal", "signal_date string, category string, source string",
                 [("2024-01-15", "market", "s")]) == [["MISSING_TITLE"]]


def test_ticket_enums_allow_escalated(frame):
    schema = ("ticket_number string, created_at string, category string, priority string, "
              "status string")
    rows = [("T", "2024-01-15", "c", " HIGH ", "Escalated"), ("T", "2024-01-15", "c", "urgent", "open")]
    assert codes(frame, "ticket", schema, rows) == [[], ["INVALID_ENUM_PRIORITY"]]


def test_quarantine_totals(frame):
    schema = ("ticket_number string, created_at string, category string, priority string, "
              "status string")
    checked = validate(frame(schema, [("T", "x", "c", "low", "open"), ("U", "2024-01-15", "c", "low", "open")]),
                       "ticket")
    totals = checked.totals().first()
    assert (totals.total_rows, totals.valid_rows, totals.quarantined_rows) == (2, 1, 1)
    assert totals.quarantine_rate == 0.5
    bad = checked.quarantined.first()
    assert bad.error_details == "'created_at' could not be parsed as a date: x"
    assert json.loads(bad.raw_data)["ticket_number"] == "T"
    empty = validate(frame(schema, [("T", "x", "c", "low", "open")]).filter(F.lit(False)), "ticket")
    assert empty.totals().first().quarantine_rate == 0.0
