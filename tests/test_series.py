from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.timeparts import FEATURES
from tidewatch.operators import anomaly, dashboard, forecast, forest
from tidewatch.operators import series as S

START = date(2024, 1, 1)


def daily(spark, values, key=None):
    rows = [(key or "s", START + timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ds date, y double")


def trend(n, slope=0.5, noise=2.0):
    rng = np.random.default_rng(3)
    return [float(20 + slope * i + rng.normal(0, noise)) for i in range(n)]


def one_off(days, usual, position, size):
    """A constant series that is interrupted on a single day."""
    return [size if i == position else usual for i in range(days)]


# --- z-score ------------------------------------------------------------------------------
def test_flat_series_has_no_anomaly(spark):
    flat = daily(spark, [7.5] * 21)
    assert anomaly.zscore_anomalies(flat, "ticket_volume").count() == 0
    assert anomaly.iqr_anomalies(flat, "ticket_volume").count() == 0


def test_spike_is_found_at_two(spark):
    rows = anomaly.zscore_anomalies(daily(spark, one_off(24, 40.0, 9, 180.0)), "ticket_volume", 2.0)
    found = {r.date: r for r in rows.collect()}
    hit = found[START + timedelta(days=9)]
    assert hit.z_score == pytest.approx(2.268, abs=1e-3)
    assert hit.expected_value == pytest.approx(60.0)
    assert hit.severity == "low" and hit.correlated_fields == {"rolling_window": 7.0, "threshold": 2.0}
    assert hit.likely_cause.startswith("Notable increase in support demand")


def test_centered_window_cannot_exceed_its_bound(spark):
    rows = daily(spark, one_off(24, 40.0, 9, 1e9))
    assert anomaly.zscore_anomalies(rows, "ticket_volume", 2.5).count() == 0


def test_neighbours_without_the_value_itself(spark):
    values = [10.0 + (i % 3) for i in range(30)]
    values[15] = 100.0
    rows = anomaly.zscore_anomalies(daily(spark, values), "absent", baseline="exclude_self")
    found = {r.date: r for r in rows.collect()}
    near = np.array(values[12:15] + values[16:19])
    hit = found[START + timedelta(days=15)]
    assert hit.z_score == pytest.approx((100 - near.mean()) / near.std(ddof=1))
    assert hit.severity == "critical"


def test_short_series_give_nothing(spark):
    assert anomaly.zscore_anomalies(daily(spark, one_off(6, 2.0, 4, 11.0)), "m", 0.1).count() == 0
    assert anomaly.iqr_anomalies(daily(spark, [1.0, 1.0, 9.0]), "m").count() == 0


def test_many_series_do_not_touch_each_other(spark):
    both = daily(spark, [7.5] * 21, "flat").union(daily(spark, one_off(24, 40.0, 9, 180.0), "spiky"))
    found = anomaly.zscore_anomalies(both, "absent", 2.0, by=["k"]).select("k").distinct().collect()
    assert [r.k for r in found] == ["spiky"]


def test_unknown_baseline(spark):
    with pytest.raises(ValueError):
        anomaly.zscore_anomalies(daily(spark, [1.0]), "m", baseline="x")


# --- interquartile range --------------------------------------------------------------------
def test_iqr_outlier(spark):
    (hit,) = anomaly.iqr_anomalies(daily(spark, one_off(17, 8.0, 6, 70.0)), "demand_units").collect()
    assert hit.observed_value == 70.0 and hit.expected_value == 8.0 and hit.severity == "high"
    assert hit.likely_cause == "Significant demand surge — verify staffing coverage"


def test_causes(spark):
    rows = spark.createDataFrame(
        [("absent", 1.0, 5.0, -4.0), ("utilization_rate", 9.0, 5.0, 3.0), ("other", 1.0, 5.0, 4.0)],
        "m string, o double, e double, z double")
    told = rows.select(anomaly.infer_cause(F.col("m"), F.col("o"), F.col("e"), F.col("z"))).collect()
    assert [r[0] for r in told] == [
        "Unusually low absences — data completeness check recommended",
        "Over-utilization detected — risk of burnout and quality degradation",
        "Significant downward deviation in other"]


def test_every_series_has_a_report(spark):
    given = daily(spark, [7.5] * 21, "quiet").union(daily(spark, one_off(24, 40.0, 9, 180.0), "loud")).union(
        daily(spark, [1.0, 2.0, 99.0], "short")).union(daily(spark, [3.0] * 5, None))
    found = anomaly.zscore_anomalies(given, "ticket_volume", 2.0, by=["k"])
    rows = {r.k: r for r in anomaly.detector_reports(given, found, "ticket_volume", "Z-Score", 7, ["k"]).collect()}
    assert set(rows) == {"quiet", "loud", "short", "s"}
    assert (rows["loud"].anomalies, rows["loud"].total_points, rows["loud"].anomaly_rate) == (1, 24, 0.0417)
    assert rows["loud"].summary == "Detected 1 anomalies in ticket volume: 1 warnings."
    assert rows["quiet"].summary == "No anomalies detected in ticket_volume." and rows["quiet"].detection_method == "Z-Score"
    for key, n in (("short", 3), ("s", 5)):
        assert rows[key].total_points == n and rows[key].detection_method == "none — insufficient data"
        assert rows[key].summary.startswith("Not enough data")
    (lone,) = anomaly.detector_reports(given.limit(0), found.limit(0), "absent", "IQR", 4).collect()
    assert (lone.total_points, lone.anomalies, lone.anomaly_rate) == (0, 0, 0.0)


# --- multivariate ------------------------------------------------------------------------------
FIELDS = ["ticket_count", "critical_count", "sla_breaches", "avg_resolution_min"]


def days(spark, n=60, odd=(20,), key="a"):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        row = [100 + rng.normal(0, 5), 5 + rng.normal(0, 1), 10 + rng.normal(0, 2), 300 + rng.normal(0, 20)]
        if i in odd:
            row = [300.0, 60.0, 150.0, 2000.0]
        rows.append((key, START + timedelta(days=i), *[float(v) for v in row]))
    return spark.createDataFrame(rows, "k string, date date, " + ", ".join(f"{f} double" for f in FIELDS))


def test_forest_finds_a_planted_outlier_first(spark):
    found = anomaly.multivariate_anomalies(days(spark), "ticket_count", "tickets", FIELDS)
    rows = found.orderBy("anomaly_score").collect()
    assert rows[0].date == START + timedelta(days=20) and rows[0].severity == "critical"
    assert 1 <= len(rows) <= 3 and -1 <= rows[0].anomaly_score < -0.6
    assert rows[0].correlated_fields["critical_count"] == 60.0
    assert rows[0].likely_reasons[:2] == [
        "Unusually high ticket volume — possible system incident or product release",
        "Critical tickets present: 60"]


def test_forest_is_repeatable_and_per_series(spark):
    both = days(spark, odd=(20,), key="a").union(days(spark, odd=(40,), key="b"))

    def run(df):
        found = anomaly.multivariate_anomalies(df, "ticket_count", "tickets", FIELDS, by=["k"])
        return sorted((r.k, r.date, r.anomaly_score) for r in found.collect())

    first = run(both)
    assert first == run(both.repartition(3))
    lowest = {k: min((s, d) for kk, d, s in first if kk == k)[1] for k in "ab"}
    assert lowest == {"a": START + timedelta(days=20), "b": START + timedelta(days=40)}


def test_forest_scores_do_not_depend_on_blocks(spark):
    long = days(spark, 900, odd=(20, 700))

    def run(rows):
        found = forest.isolation_scores(long, FIELDS, trees=20, sample=32, block_rows=rows)
        return sorted((r.date, r.anomaly_score) for r in found.collect())

    blocked = run(64)
    assert len(blocked) == 900 and blocked == run(10_000)
    assert {d for _, d in sorted((s, d) for d, s in blocked)[:2]} == {
        START + timedelta(days=20), START + timedelta(days=700)}


def test_forest_draw_is_that_of_all_rows(spark):
    rows = spark.range(20_000).select(
        F.xxhash64(F.lit(42), F.lit(3), "id").alias("c"), F.lit(20_000).alias("n"))
    kept = rows.filter(forest.likely_drawn("c", "n", 256))
    assert 256 < kept.count() < 1200
    least = [r.c for r in rows.orderBy("c").limit(256).collect()]
    assert [r.c for r in kept.orderBy("c").limit(256).collect()] == least
    assert rows.withColumn("n", F.lit(200)).filter(forest.likely_drawn("c", "n", 256)).count() == 20_000


def test_forest_imputes_missing_measures(spark):
    gaps = days(spark).withColumn(
        "avg_resolution_min", F.when(F.dayofmonth("date") != 3, F.col("avg_resolution_min")))
    assert anomaly.multivariate_anomalies(gaps, "ticket_count", "tickets", FIELDS).count() >= 1


def test_few_days_give_nothing(spark):
    for method in ("forest", "zscore"):
        found = anomaly.multivariate_anomalies(
            days(spark, 9, odd=(3,)), "ticket_count", "tickets", FIELDS, method=method)
        assert found.count() == 0
        summary = anomaly.anomaly_summary(found, "ticket_count").first()
        assert summary.summary == "No anomalies detected in ticket_count."


def test_summary_names_three_critical_days(spark):
    rows = [("2024-01-0%d" % i, "critical", 50) for i in range(1, 6)] + [("2024-01-09", "warning", 50)]
    df = spark.createDataFrame(rows, "date string, severity string, total_points long")
    row = anomaly.anomaly_summary(df, "ticket_count").first()
    assert row.summary == ("Detected 6 anomalies in ticket count: 5 critical (dates: 2024-01-01, "
                           "2024-01-02, 2024-01-03...) 1 warnings.")
    assert row.anomaly_rate == 0.12


def test_severity_counts_are_zero_filled(spark):
    df = spark.createDataFrame([("low",), ("low",)], "severity string")
    assert {r.severity: r["count"] for r in anomaly.severity_counts(df).collect()} == {
        "critical": 0, "high": 0, "medium": 0, "low": 2}


# --- ridge -------------------------------------------------------------------------------------
def numpy_features(dates, start):
    rows = []
    for d in dates:
        dow, month = d.weekday(), d.month
        rows.append([dow, d.day, month, d.isocalendar()[1], (d - start).days,
                     np.sin(2 * np.pi * dow / 7), np.cos(2 * np.pi * dow / 7),
                     np.sin(2 * np.pi * month / 12), np.cos(2 * np.pi * month / 12)])
    return np.array(rows, dtype=float)


@pytest.mark.parametrize("extrapolate", [False, True])
def test_ridge_matches_the_closed_form(spark, extrapolate):
    values = trend(60)
    points = forecast.ridge_forecast(
        daily(spark, values), horizon=14, extrapolate_trend=extrapolate).orderBy("ds").collect()
    assert len(points) == 74 and sum(p.is_forecast for p in points) == 14
    y, dates = np.array(values), [START + timedelta(days=i) for i in range(60)]
    x = numpy_features(dates, START)
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    z = (x - mean) / std
    beta = np.linalg.solve(z.T @ z + np.eye(9), z.T @ (y - y.mean()))
    fit = y.mean() + z @ beta
    assert [p.predicted for p in points[:60]] == pytest.approx(fit.tolist(), abs=1e-8)
    ahead = [START + timedelta(days=60 + i) for i in range(14)]
    zf = (numpy_features(ahead, START if extrapolate else ahead[0]) - mean) / std
    assert [p.predicted for p in points[60:]] == pytest.approx(
        np.maximum(y.mean() + zf @ beta, 0).tolist(), abs=1e-8)
    assert points[0].rmse == pytest.approx(np.sqrt(np.mean((y - fit) ** 2)))
    assert points[0].mae == pytest.approx(np.mean(np.abs(y - fit)))
    assert points[0].upper_bound - points[0].predicted == pytest.approx(1.96 * np.std(y - fit))
    assert all(p.lower_bound <= p.upper_bound for p in points)


def test_ridge_confidence_fills_gaps_and_clamps(spark):
    values = trend(30)
    values[4] = None
    narrow = forecast.ridge_forecast(daily(spark, values), horizon=7, confidence=0.9).collect()
    assert len(narrow) == 37 and all(p.predicted is not None for p in narrow)
    falling = forecast.ridge_forecast(daily(spark, [100.0 - 4 * i for i in range(26)]), horizon=30,
                                      extrapolate_trend=True).filter("is_forecast")
    assert falling.agg(F.min("predicted")).first()[0] == 0.0


def test_ridge_leaves_short_series_out_and_names_them(spark):
    both = daily(spark, trend(30), "long").union(daily(spark, [10.0], "short"))
    assert {r.k for r in forecast.ridge_forecast(both, ["k"], 7).select("k").distinct().collect()} == {"long"}
    (row,) = forecast.too_short(both, ["k"]).collect()
    assert row.k == "short" and "at least 7" in row.error
    with pytest.raises(ValueError, match="at least 7"):
        forecast.require_points(daily(spark, [10.0]))


@pytest.mark.parametrize("horizon", [6, 91])
def test_horizon_bounds(spark, horizon):
    with pytest.raises(ValueError):
        forecast.ridge_forecast(daily(spark, trend(30)), horizon=horizon)


def test_features(spark):
    rows = forecast.feature_frame(daily(spark, [1.0] * 400)).orderBy("ds").collect()
    dates = [START + timedelta(days=i) for i in range(400)]
    found = np.array([[r[f] for f in FEATURES] for r in rows])
    assert np.allclose(found, numpy_features(dates, START))


# --- linear, naive, Holt-Winters -------------------------------------------------------------
def test_linear_matches_polyfit(spark):
    values = trend(40)
    (model,) = forecast.run_forecast(daily(spark, values), horizon=10).collect()
    slope, icept = np.polyfit(np.arange(40), values, 1)
    assert model["values"] == pytest.approx((slope * np.arange(40, 50) + icept).tolist())
    assert model.sigma == pytest.approx(np.std(np.array(values) - (slope * np.arange(40) + icept)))
    assert model.trend_direction == "up" and model.methodology == "Linear Trend Regression"


def test_naive_below_seven_points(spark):
    (model,) = forecast.run_forecast(daily(spark, [1.0, 2.0, 6.0]), horizon=7).collect()
    assert model["values"] == [3.0] * 7 and model.sigma == pytest.approx(np.std([1, 2, 6], ddof=1))
    (row,) = forecast.summarize(forecast.run_forecast(daily(spark, [4.0]), horizon=7), "demand", 7).collect()
    assert row.sigma == 0.0 and row.summary == (
        "Insufficient history for trend analysis. Forecasting flat at mean of 4.0.")
    assert forecast.run_forecast(daily(spark, [None]), horizon=7).count() == 0


def test_points_band_grows(spark):
    series = daily(spark, trend(100))
    models = forecast.run_forecast(series, horizon=10)
    points = forecast.build_points(models).orderBy("ds").collect()
    assert sum(p.is_actual for p in points) == 60 and len(points) == 70
    ahead = [p for p in points if not p.is_actual]
    widths = [p.upper_ci - p.lower_ci for p in ahead]
    assert widths == sorted(widths) and ahead[0].ds == START + timedelta(days=100)
    (model,) = models.collect()
    assert widths[9] == pytest.approx(2 * 1.96 * model.sigma * 1.18, abs=0.02)


def test_holt_winters_follows_a_weekly_pattern(spark):
    week = [10.0, 12.0, 14.0, 13.0, 11.0, 5.0, 4.0]
    values = [week[i % 7] + 0.1 * i for i in range(84)]
    (model,) = forecast.run_forecast(daily(spark, values), horizon=14, smoothing=True).collect()
    assert model.methodology == "Holt-Winters Exponential Smoothing"
    expected = [week[i % 7] + 0.1 * i for i in range(84, 98)]
    assert model["values"] == pytest.approx(expected, abs=1.0) and model.mape < 15


def test_holt_winters_falls_back_to_linear(spark):
    (model,) = forecast.run_forecast(daily(spark, trend(8)), horizon=7, smoothing=True).collect()
    assert model.methodology == "Linear Trend Regression"


@pytest.mark.parametrize("values, trend_", [
    ([10.0, 10.0, 11.0, 11.0], "up"), ([10.0, 10.0, 9.0, 9.0], "down"), ([10.0, 10.0, 10.4, 10.4], "flat")])
def test_detect_trend(spark, values, trend_):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(forecast.detect_trend(F.col("v"), 4)).first()[0] == trend_


def test_forecast_summary(spark):
    rows = forecast.forecast_ticket_volume(daily(spark, [float(i) for i in range(1, 15)]), horizon=10)
    row = rows.first()
    assert row.summary == ("Ticket Volume is forecast to increase by 77.3% over the next 10 days "
                           "(from avg 11.0 to 19.5). Trend direction: up.")


def test_split_of_history_and_forecast(spark):
    points = forecast.ridge_forecast(daily(spark, trend(30)), horizon=7)
    rows = dashboard.split_forecast(points).collect()
    assert {r.split_date for r in rows} == {START + timedelta(days=30)}
    assert all((r.actual is None) == r.is_forecast for r in rows)


def test_unknown_metric(spark):
    with pytest.raises(ValueError, match="Unknown metric"):
        S.metric_series(None, None, "invalid_metric", "2024-01-01", "2024-01-31")
