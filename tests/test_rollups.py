"""Reports over a stored warehouse: partial rows of every load, and folders of the period's months only."""

import pytest

from tidewatch.operators import rollups, tickets, workforce
from tidewatch.plans import ingest, stored_queries
from tidewatch.sources.warehouse import Warehouse

AS_OF = "2024-01-20 00:00:00"
TICKETS = ("ticket_id string, created_at string, resolved_at string, category string, priority string, "
           "status string, sentiment_score string")
HOURS = ("employee_id string, date string, scheduled_hours string, actual_hours string, department_code string, "
         "demand_units string, capacity_units string")


@pytest.fixture()
def store(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "warehouse"))


def _pruned(df) -> list[bool]:
    """For each scan of the plan, whether months prune its folders."""
    text = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    return ["month" in s.split("PartitionFilters: [")[1].split("]")[0] for s in scans]


def _tables(df) -> set[str]:
    return {f.split("/data/")[0].split("/")[-1] for f in df.inputFiles()}


def test_ticket_reports_from_several_loads(frame, store):
    months = [f"2024-0{m}-{d:02d}" for m in range(1, 7) for d in (3, 17)]
    for load in range(2):
        rows = [(f"T{load}-{i}", f"{day} 08:00:00", f"{day} 20:00:00" if i % 3 else "", "c", "low",
                 "resolved" if i % 3 else "open", str(0.1 * i) if i % 4 else "") for i, day in enumerate(months)]
        # loaded twice under one name: the second time adds nothing, neither facts nor partial rows
        for _ in range(2):
            ingest.ingest_feed(store, frame(TICKETS, rows), "tickets", "f", AS_OF, AS_OF, commit=f"load-{load}")
    span = ("2024-02-01", "2024-03-31")
    facts = store.read("fact_ticket")
    found = stored_queries.stored_trends(store, *span)
    assert found.collect() == tickets.ticket_trends(facts, *span).select(*found.columns).collect()
    assert found.count() == 4
    sla = stored_queries.stored_sla(store, *span)
    assert sorted(map(str, sla.collect())) == sorted(map(str, tickets.sla_report(facts, *span).collect()))
    assert _pruned(found) and all(_pruned(found)) and _pruned(sla) and all(_pruned(sla))
    assert _tables(found) == {"daily_ticket"}  # no fact is read for the trends


def test_hours_reports_from_several_loads(spark, frame, store):
    for load in range(2):
        rows = [(f"E{load}{i % 3}", f"2024-0{1 + i % 5}-{1 + i // 5:02d}", "8", str(i % 9), "ENG" if i % 2 else None,
                 str(10 + i), str(9 + i % 4)) for i in range(60)]
        ingest.ingest_feed(store, frame(HOURS, rows), "workforce", "f", AS_OF, AS_OF)
    span = ("2024-02-01", "2024-04-30")
    facts, departments = store.read("fact_operations"), store.read("dim_department")
    found = stored_queries.stored_summary(store, *span)
    want = workforce.workforce_summary(facts, *span)
    assert found.first().asDict() == want.first().asDict()
    gaps = stored_queries.stored_gaps(store, departments, *span)
    assert gaps.collect() == workforce.staffing_gaps(facts, departments, *span).collect() and gaps.count() > 3
    assert _tables(found) == {"daily_operations", "fact_operations"} and all(_pruned(found))
    assert _tables(gaps) == {"daily_operations", "dim_department"} and any(_pruned(gaps))


def test_partial_rows_of_an_empty_load(frame, store):
    feed = frame(TICKETS, [("T1", "bad", "", "c", "low", "open", "")])
    ingest.ingest_feed(store, feed, "tickets", "f", AS_OF, AS_OF)
    assert store.read("daily_ticket") is None and store.read("fact_ticket") is None
    assert rollups.ROLLUPS["fact_ticket"][0] == "daily_ticket"
