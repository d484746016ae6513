"""The smoothing recursion in the JVM against the vectorised one, and the search against its own grid."""

import datetime as dt

import numpy as np
import pytest

from tidewatch.operators import forecast, smoothing

START = dt.date(2024, 1, 1)


def _series(rng, n, weekly):
    week = rng.normal(0, 5, 7) if weekly else np.zeros(7)
    return [float(40 + 0.3 * i + week[i % 7] + rng.normal()) for i in range(n)]


def test_recursion_equals_the_vectorised_one(spark):
    rng = np.random.default_rng(8)
    given = {"weekly": _series(rng, 60, True), "short": _series(rng, 20, False), "edge": _series(rng, 28, True),
             "nine": _series(rng, 9, False), "eight": _series(rng, 8, False), "flat": [3.0] * 40, "zero": [0.0] * 30}
    rows = [(k, START + dt.timedelta(days=i), y) for k, v in given.items() for i, y in enumerate(v)]
    series = spark.createDataFrame(rows, "k string, ds date, y double").repartition(3)
    found = {r.k: r for r in smoothing.smoothing_forecast(series, ["k"], 10, 0.3, 0.1, 0.2).collect()}
    grids = [np.array([0.3]), np.array([0.1]), np.array([0.2])]
    for k, v in given.items():
        y, seasonal = np.array(v), len(v) >= 28
        held = max(7, int(len(y) * 0.2))
        if len(y) - held < (14 if seasonal else 2):
            assert found[k]["values"] is None and found[k].mape is None and found[k].sigma is None
            continue
        _, fitted, ahead = forecast.smooth(y, 10, seasonal, grids)
        assert found[k]["values"] == pytest.approx(ahead.tolist(), abs=1e-9)
        assert found[k].sigma == pytest.approx(np.std(y - fitted, ddof=1), abs=1e-6)
        _, _, guess = forecast.smooth(y[:-held], held, seasonal, grids)
        test = y[-held:]
        if (test != 0).any():
            assert found[k].mape == pytest.approx(np.mean(np.abs((test - guess) / test)) * 100, abs=1e-9)
        else:
            assert found[k].mape is None
    assert found["eight"].points == 8 and found["eight"]["values"] is None


def test_no_python_in_the_plan(spark):
    series = spark.createDataFrame([("a", START, 1.0)], "k string, ds date, y double")
    text = smoothing.smoothing_forecast(series, ["k"], 3, 0.3, 0.1, 0.2)._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text


@pytest.mark.parametrize("n, weekly", [(60, True), (21, False), (35, True)])
def test_the_search_is_no_worse_than_its_grid(n, weekly):
    y = np.array(_series(np.random.default_rng(n), n, weekly))
    seasonal = n >= 28

    def error(fitted):
        return ((y - fitted) ** 2).sum()

    found, _ = forecast.holt_winters(y, 5, seasonal)
    steps = np.linspace(0.05, 0.95, 5)
    for a in steps:
        for b in steps:
            for c in steps if seasonal else [0.0]:
                _, fitted, _ = forecast.smooth(y, 5, seasonal, [np.array([v]) for v in (a, b, c)])
                assert error(found) <= error(fitted) + 1e-9
