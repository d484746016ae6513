"""What a load computes, shuffles and keeps for each row of its feed."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import cleaning, loading
from tidewatch.operators.validation import validate
from tidewatch.plans import ingest
from tidewatch.sources import feeds
from tidewatch.sources.warehouse import Warehouse

AT = "2024-01-31 00:00:00"
HOURS = "employee_code string, date string, scheduled_hours string, actual_hours string"
FEED = "employee_id string, date string, scheduled_hours string, actual_hours string"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_json_and_texts_are_made_of_bad_records_only(frame):
    checked = validate(frame(HOURS, [("E1", "2024-01-15", "8", "7"), ("E2", "x", "8", "-1")]), "operations")
    assert checked.judged.columns == ["row_index", *(c.split()[0] for c in HOURS.split(", ")), "is_valid"]
    assert "to_json" not in _plan(checked.judged) and "to_json" not in _plan(checked.valid)
    (bad,) = checked.quarantined.collect()
    assert bad.error_codes == ["INVALID_DATE_DATE", "NEGATIVE_ACTUAL_HOURS", "OUT_OF_RANGE_ACTUAL_HOURS"]
    assert json.loads(bad.raw_data) == {
        "employee_code": "E2", "date": "x", "scheduled_hours": "8", "actual_hours": "-1"}
    good, _ = checked.tagged.orderBy("row_index").collect()
    assert good.is_valid and good.error_codes == [] and json.loads(good.raw_data)["date"] == "2024-01-15"


def test_a_run_without_employees_ends_before_records_are_written(spark, frame, tmp_path, monkeypatch):
    names = []
    monkeypatch.setattr(ingest, "written", lambda df, name: names.append(name))
    store = Warehouse(spark, str(tmp_path))
    feed = frame(HOURS, [("E1", "2024-01-15", "8", "7"), ("E1", "2024-01-16", "8", "7"), ("E2", "x", "8", "7")])
    with pytest.raises(ValueError, match="load the employee records"):
        ingest.ingest_records(store, feed, "operations", "R", "f.csv", AT, 0.5, clock=lambda: AT)
    assert names == []
    assert [r.status for r in store.read("ingestion_run").collect()] == ["failed"]
    assert store.read("quarantined_row").count() == 1
    assert sorted(str(r.date) for r in store.read("dim_date").collect()) == ["2024-01-15", "2024-01-16"]


def test_cleaners_keep_the_json_of_bad_rows_only(frame):
    hours = cleaning.clean_workforce(frame(FEED, [
        ("E1", "2024-01-15", "8", "7"), ("E1", "bad", "8", "7"), ("E2", "2024-01-15", "30", "7"), (None, None, None, None)]))
    rows = {r.row_index: r for r in hours.tagged.collect()}
    assert [rows[i].error_code for i in range(4)] == [None, "invalid_date", "hours_out_of_range", "invalid_date"]
    assert rows[0].raw_data is None and json.loads(rows[2].raw_data) == {
        "employee_id": "E2", "date": "2024-01-15", "scheduled_hours": "30", "actual_hours": "7"}
    assert json.loads(rows[1].raw_data)["date"] == "bad" and json.loads(rows[3].raw_data)["date"] is None
    schema = "ticket_id string, created_at string, category string, priority string, status string"
    tickets = cleaning.clean_tickets(frame(schema, [("T1", "2024-01-15", "c", "low", "open"), ("T2", "x", "c", "low", "open")]), AT)
    assert [r.raw_data is None for r in tickets.tagged.orderBy("row_index").collect()] == [True, False]
    signals = cleaning.clean_market_signals(frame("signal_date string, title string", [("2024-01-15", "a"), ("x", "b")]))
    good, bad = signals.tagged.orderBy("row_index").collect()
    assert good.raw_data is None and json.loads(bad.raw_data) == {"signal_date": "x", "title": "b"}


def test_numbers_that_are_parsed_are_not_parsed_again(frame):
    hours = cleaning.clean_workforce(frame(FEED, [("E1", "2024-01-15", "8", "7.25")]))
    parsed = hours.clean.localCheckpoint()
    facts = loading.operations_facts(parsed, "f.csv")
    assert "RLIKE" not in _plan(facts).upper()
    (row,) = facts.collect()
    assert (row.scheduled_hours, row.actual_hours, row.tasks_completed) == (8.0, 7.25, 0)
    odd = parsed.withColumn("actual_hours", F.lit(float("nan"))).withColumn("demand_units", F.lit("1e1"))
    (row,) = loading.operations_facts(odd, "f.csv").collect()
    assert (row.actual_hours, row.demand_units) == (0.0, 10.0)


def test_derived_columns_are_made_after_rows_are_dealt_to_months(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path))
    rows = spark.sql("select date'2024-01-15' as date, 'a' as k union all select date'2024-02-03', 'b' union all select null, 'c'")
    seen = []

    def layout(dealt):
        seen.append(_plan(dealt))
        return dealt.select("date", "k", F.xxhash64("k").alias("key"))

    assert store.append("fact_operations", rows, "one", layout) == 3
    assert "RebalancePartitions" in seen[0] and "xxhash64" not in seen[0]
    store.append("fact_operations", layout(rows), "two")
    stored = sorted(tuple(map(str, r)) for r in store.read("fact_operations").drop("month").collect())
    assert stored[::2] == stored[1::2] and len(stored) == 6
    assert store.read_between("fact_operations", "2024-02-01", "2024-02-28").count() == 2


def test_lines_meet_their_suppliers_without_a_shuffle(spark, tmp_path):
    """A joined table has no measured size; the product of sizes that Spark assumes made a shuffle join of it."""
    spark.sql("""select id as s_suppkey, id % 25 as s_nationkey, concat('s', id) as s_name from range(60000)""").write.parquet(
        str(tmp_path / "supplier.parquet"))
    spark.sql("select id as n_nationkey, concat('N', id) as n_name, id % 5 as n_regionkey from range(25)").write.parquet(
        str(tmp_path / "nation.parquet"))
    spark.sql("""select id as l_orderkey, id as l_partkey, id as l_suppkey, 1 as l_linenumber, 5.0D as l_quantity,
        1.0D as l_extendedprice, 0.1D as l_tax, timestamp'2024-01-15' as l_shipdate from range(100)""").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    feed = feeds.raw_workforce(spark, str(tmp_path))
    assert "SortMergeJoin" not in feed._jdf.queryExecution().sparkPlan().toString()
    rows = feed.orderBy("row_index").collect()
    assert len(rows) == 100 and rows[7].location_code == "N7" and rows[7].employee_id == "EMP7"
