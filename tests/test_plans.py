"""The physical plans are the ones that hold at scale."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import forecast, tickets
from tidewatch.operators.dedup import dedup
from tidewatch.plans import all_queries
from tidewatch.sources.warehouse import Warehouse

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_cuts_hot_keys_before_the_shuffle(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("row_index"))
    text = plan(dedup(rows, ["k"]))
    partial, shuffle = text.index("row_number(), 1, Partial"), text.index("Exchange hashpartitioning")
    assert partial > shuffle  # plans are printed top down: the cut is below the shuffle
    assert dedup(rows, ["k"]).count() == 20_001
    assert dedup(rows, ["k"], "last").filter("k = 0").first().row_index == 29_997


def test_hot_day_and_hot_priority(spark):
    """A third of all tickets on one day, half of them with one priority."""
    rows = spark.range(20_000).select(
        F.col("id").cast("string").alias("ticket_id"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-01").cast("date"))
        .otherwise(F.date_add(F.lit("2024-01-02").cast("date"), (F.col("id") % 20).cast("int")))
        .alias("created_date"),
        F.when(F.col("id") % 2 == 0, "high").otherwise("low").alias("priority"),
        F.when(F.col("id") % 2 == 0, 8.0).otherwise(72.0).alias("sla_target_hours"),
        (F.col("id") % 5 == 0).alias("sla_breached"), F.lit("open").alias("status"),
        (F.col("id") % 1000 / 10).alias("actual_resolution_hours"), F.lit(0.0).alias("sentiment_score"))
    report = tickets.sla_report(rows, "2024-01-01", "2024-01-31", accuracy=200).collect()
    assert [(r.priority, r.total) for r in report] == [("high", 10_000), ("low", 10_000)]
    even = [i % 1000 / 10 for i in range(0, 20_000, 2)]
    expected = sorted(even)[int(0.95 * 9999)]
    assert report[0].p95_resolution_hours == pytest.approx(expected, abs=0.2)
    daily = tickets.ticket_trends(rows, "2024-01-01", "2024-01-31")
    assert daily.agg(F.sum("created_count")).first()[0] == 20_000


def test_month_folders_and_days_prune(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path))
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-06-30')) as created_date")
    store.append("fact_ticket", days.withColumns(
        {"status": F.lit("open"), "unused": F.lit("x"), "ticket_id": F.lit("t")}))
    rows = store.read_between("fact_ticket", "2024-02-10", "2024-03-05")
    assert rows.count() == 25
    text = rows.groupBy("status").count()._jdf.queryExecution().toString()
    scan = text[text.index("== Physical Plan =="):]
    assert "PartitionFilters: [isnotnull(month" in scan
    assert "GreaterThanOrEqual(created_date,2024-02-10)" in scan
    assert "ReadSchema: struct<created_date:date,status:string>" in scan
    assert len(os.listdir(store.path("fact_ticket"))) - 2 <= 6


# queries that stand for their family
SAMPLE = ["g1_workforce_summary", "g5_staffing_gaps", "g10_sla_report", "g12_market_signals",
          "b31_clean_tickets", "c0_validate_operations", "a10_upsert_tickets", "e4_new_employees",
          "l10_zscore_anomalies", "m1_period_kpis"]


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_no_cross_join_and_no_python_in_the_plan(spark, name):
    text = plan(all_queries()[0][name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                     "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert operator not in text


def test_a_lone_series_is_not_cross_joined(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-02-29')) as ds")
    series = days.withColumn("y", F.dayofmonth("ds").cast("double"))
    text = plan(forecast.ridge_forecast(series, horizon=7))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@needs_data
def test_scans_read_only_the_columns_in_use(spark):
    text = plan(all_queries()[0]["g8_ticket_trends"](spark, SF))
    assert "event_type" not in text.split("ReadSchema:")[1].split("\n")[0]
