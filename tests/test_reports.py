import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import dashboard, market, tickets, workforce
from tidewatch.operators.periods import prior_period
from tidewatch.operators.quantiles import exact_percentile, percentile_brackets


def percentiles(df, p, accuracy):
    n, low, high = percentile_brackets(F.col("x"), p, accuracy)
    per = df.groupBy("g").agg(n.alias("_n"), low.alias("_low"), high.alias("_high"))
    return {r.g: r.v for r in exact_percentile(df, per, ["g"], "x", p, "v").collect()}


@pytest.mark.parametrize("p", [0.05, 0.5, 0.95, 0.99])
@pytest.mark.parametrize("accuracy", [50, 1000])
def test_exact_percentile_with_ties_and_a_hot_group(spark, p, accuracy):
    rng = np.random.default_rng(7)
    data = {"hot": np.round(rng.exponential(10, 30_000), 2), "flat": np.full(5_000, 3.0),
            "small": rng.normal(size=17), "two": np.array([1.0, 2.0]), "one": np.array([5.0]),
            None: rng.integers(0, 4, 4_000).astype(float)}
    rows = [(g, float(x)) for g, xs in data.items() for x in xs] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    found = percentiles(df, p, accuracy)
    assert set(found) == set(data)
    for g, xs in data.items():
        assert found[g] == pytest.approx(np.quantile(xs, p), abs=1e-12)


def test_percentile_of_a_group_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, x double")
    assert percentiles(df, 0.95, 100) == {"b": 1.0}


TICKET = ("ticket_id string, created_date date, priority string, status string, category string, "
          "sla_target_hours double, actual_resolution_hours double, sla_breached boolean, "
          "sentiment_score double, escalated boolean, department_code string")


@pytest.fixture()
def facts(spark):
    rows = [
        ("1", "2024-01-01", "high", "resolved", "a", 8.0, 1.0, False, 0.5, False, "X"),
        ("2", "2024-01-01", "high", "open", "a", 8.0, None, True, -0.5, True, "X"),
        ("3", "2024-01-02", "critical", "closed", "b", 4.0, 10.0, True, 0.0, False, "Y"),
        ("4", "2024-01-02", "low", "closed", "a", 72.0, 2.0, False, 0.0, False, "Y"),
        ("5", "2024-01-02", "low", "resolved", "a", 72.0, None, False, 0.0, False, "Y"),
        ("6", "2024-01-03", "critical", "in_progress", "b", 4.0, None, False, 0.2, False, "X"),
    ]
    df = spark.createDataFrame(rows, TICKET.replace("created_date date", "created_date string"))
    return df.withColumn("created_date", F.col("created_date").cast("date"))


def test_trends_clamp_after_the_running_sum(facts):
    rows = tickets.ticket_trends(facts, "2024-01-01", "2024-01-03").collect()
    assert [(r.created_count, r.resolved_count, r.net_change, r.cumulative_open) for r in rows] == [
        (2, 1, 1, 1), (3, 3, 0, 1), (1, 0, 1, 2)]
    later = tickets.ticket_trends(facts, "2024-01-02", "2024-01-03").collect()
    assert [r.cumulative_open for r in later] == [0, 1]
    assert later[0].avg_sentiment == 0.0  # a mean of zero is a value


def test_summary_of_an_empty_period_is_one_row_of_zeros(facts):
    row = tickets.ticket_summary(facts, "2030-01-01", "2030-01-31").first()
    assert (row.total, row.open, row.sla_breach_rate_pct, row.avg_resolution_hours) == (0, 0, 0.0, 0.0)


def test_sla_report_order_and_missing_resolution(facts):
    rows = tickets.sla_report(facts, "2024-01-01", "2024-01-03").collect()
    assert [r.priority for r in rows] == ["critical", "high", "low"]
    assert (rows[0].p95_resolution_hours, rows[0].breach_rate_pct) == (10.0, 50.0)
    only_open = tickets.sla_report(facts, "2024-01-03", "2024-01-03").first()
    assert (only_open.p95_resolution_hours, only_open.avg_resolution_hours) == (0.0, 0.0)


def test_department_filter(facts):
    assert tickets.ticket_summary(facts, "2024-01-01", "2024-01-31", department="X").first().total == 3


@pytest.mark.parametrize("pct, status", [
    (95.0, "over_capacity"), (80.0, "optimal"), (60.0, "underutilized"),
    (59.9, "critical_underutilization")])
def test_status_bands(spark, pct, status):
    assert spark.range(1).select(workforce.classify_status(F.lit(pct))).first()[0] == status


@pytest.mark.parametrize("gap, capacity, severity", [
    (26.0, 100.0, "critical"), (25.0, 100.0, "warning"), (15.0, 100.0, "low"), (1.0, 0.0, "critical")])
def test_gap_severity(spark, gap, capacity, severity):
    found = spark.range(1).select(workforce.classify_gap(F.lit(gap), F.lit(capacity))).first()[0]
    assert found == severity


def hours(spark, rows):
    schema = ("employee_id string, date string, department_code string, scheduled_hours double, "
              "actual_hours double, utilization_rate double, overtime_hours double, absent boolean, "
              "demand_units double, capacity_units double")
    return spark.createDataFrame(rows, schema).withColumn("date", F.col("date").cast("date"))


def test_workforce_summary_ratios(spark):
    rows = [("e1", "2024-01-01", "A", 8.0, 8.0, 1.0, 0.0, False, 10.0, 0.0),
            ("e1", "2024-01-02", "A", 8.0, 0.0, 0.0, 0.0, True, 10.0, 0.0),
            ("e1", "2024-01-03", "A", 8.0, 0.0, 0.0, 0.0, True, 10.0, 0.0)]
    row = workforce.workforce_summary(hours(spark, rows), "2024-01-01", "2024-01-31").first()
    assert row.absence_rate_pct == 200.0  # absences per head
    assert row.demand_coverage_pct == 1000.0  # no capacity counts as 1


def test_staffing_gap_threshold_and_limit(spark):
    rows = [(f"e{i}", f"2024-01-{i + 1:02d}", "A", 8.0, 8.0, 1.0, 0.0, False, 100.0 + i, 100.0)
            for i in range(20)]
    names = spark.createDataFrame([("A", "Alpha")], "code string, name string")
    found = workforce.staffing_gaps(hours(spark, rows), names, "2024-01-01", "2024-01-31", limit=3)
    assert [r.gap for r in found.collect()] == [19.0, 18.0, 17.0]
    every = workforce.staffing_gaps(hours(spark, rows), names, "2024-01-01", "2024-01-31")
    assert every.count() == 14  # 105 is not above 1.05 * 100


def test_prior_periods():
    assert [str(d) for d in prior_period("2024-01-15", "2024-01-30")] == ["2023-12-30", "2024-01-14"]
    assert [str(d) for d in prior_period("2024-01-15", "2024-01-30", "overview")] == [
        "2023-12-31", "2024-01-14"]
    assert [str(d) for d in prior_period("2024-01-15", "2024-01-22", "insights")] == [
        "2024-01-08", "2024-01-14"]
    with pytest.raises(ValueError):
        prior_period("2024-01-15", "2024-01-30", "other")


def test_market_report_orders_and_limits(spark):
    rows = [(i, f"2024-01-{1 + i % 9:02d}", "s", "c", "Tech" if i % 2 else None, float(i), float(i))
            for i in range(300)]
    df = spark.createDataFrame(
        rows, "row_index int, signal_date string, source string, category string, industry string, "
        "value double, change_pct double").withColumn("signal_date", F.col("signal_date").cast("date"))
    feed = market.market_signals(market.with_signal_columns(df), "2024-01-01", "2024-01-31")
    found = feed.collect()
    assert len(found) == 200 and found[0].value == 8.0 and str(found[0].signal_date) == "2024-01-09"
    assert [r.industry for r in market.change_by_industry(feed).collect()] == ["Tech"]
    grouped = market.signals_by_category(feed).first()
    assert grouped.signal_count == 200 and len(grouped.signals) == 200


def test_pages(spark):
    rows = spark.range(10)
    assert [r.id for r in dashboard.page(rows, ["id"], 2, 4).collect()] == [4, 5, 6, 7]
    total = dashboard.page_count(rows, 4).first()
    assert (total.total, total.pages) == (10, 3)
    with pytest.raises(ValueError):
        dashboard.page(rows, ["id"], 0, 4)


def test_heatmap_fills_missing_days(spark):
    rows = [("2024-01-01", "A", 50.0), ("2024-01-02", "B", 60.0), ("2024-01-03", "A", 70.0)]
    df = spark.createDataFrame(rows, "date string, department_code string, utilization_pct double")
    found = {r.department_code: (r.day_01, r.day_02) for r in dashboard.heatmap_matrix(df, 2).collect()}
    assert found == {"A": (0.0, 70.0), "B": (60.0, 0.0)}
