"""Additive Holt-Winters smoothing with given parameters, as an aggregate over the array of a series.

The recursion runs in the JVM, one row a series, whatever the number of series; a series has a value a day
at most. `operators.forecast` searches the parameters and is held against this recursion in the tests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators.forecast import MIN_POINTS, SEASON


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _mean(values: Column) -> Column:
    return C.ratio(_total(values), F.size(values))


def _start(values: Column, seasonal: bool) -> Column:
    if seasonal:
        first = _mean(F.slice(values, 1, SEASON))
        trend = (_mean(F.slice(values, SEASON + 1, SEASON)) - first) / SEASON
        season = F.transform(F.slice(values, 1, SEASON), lambda y: y - first)
    else:
        first = F.element_at(values, 1)
        trend = F.element_at(values, 2) - first
        season = F.array(F.lit(0.0))
    return F.struct(
        first.alias("level"), trend.alias("trend"), season.alias("season"),
        F.lit(0).alias("t"), F.lit(0.0).alias("errors"), F.lit(0.0).alias("squares"))


def smoothed(values: Column, alpha: float, beta: float, gamma: float, seasonal: bool) -> Column:
    """State after the last value: level, trend, season, t, and the sums of the errors and of their squares.

    The start is the mean of the first season (or the first value), the slope between the first two
    and the first season's deviations. `values` needs two seasons, or two values without a season.
    """
    m = SEASON if seasonal else 1

    def step(state: Column, y: Column) -> Column:
        at = state["t"] % m
        s = F.element_at(state["season"], (at + 1).cast("int"))
        fitted = state["level"] + state["trend"] + s
        level = alpha * (y - s) + (1 - alpha) * (state["level"] + state["trend"])
        trend = beta * (level - state["level"]) + (1 - beta) * state["trend"]
        season = state["season"]
        if seasonal:
            season = F.transform(season, lambda x, k: F.when(k == at, gamma * (y - level) + (1 - gamma) * s).otherwise(x))
        return F.struct(
            level.alias("level"), trend.alias("trend"), season.alias("season"), (state["t"] + 1).alias("t"),
            (state["errors"] + (y - fitted)).alias("errors"),
            (state["squares"] + (y - fitted) * (y - fitted)).alias("squares"))

    return F.aggregate(values, _start(values, seasonal), step)


def ahead(state: Column, steps: Column, seasonal: bool) -> Column:
    """Values of the next `steps` days."""
    m = SEASON if seasonal else 1
    return F.transform(
        F.sequence(F.lit(1), steps),
        lambda i: state["level"] + i * state["trend"]
        + F.element_at(state["season"], ((state["t"] + i - 1) % m + 1).cast("int")))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns as the output of a generator: computed once, not in every expression that reads them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def smoothing_forecast(
    series: DataFrame, keys: Sequence[str], horizon: int, alpha: float, beta: float, gamma: float
) -> DataFrame:
    """keys, points, mape, sigma, values: the forecast of each series with these parameters.

    With a weekly season from 28 points on. `mape` is measured on the last fifth, at least a week, by
    a second run without it; `sigma` is the deviation of the residuals. NULL where the series is too short.
    """
    per = series.filter(F.col("y").isNotNull()).groupBy(*keys).agg(
        F.count("*").cast("int").alias("points"),
        F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("_history"))
    per = _once(per, _values=F.transform("_history", lambda x: x["y"].cast("double")))
    n, values = F.col("points"), F.col("_values")
    held = F.greatest(F.lit(MIN_POINTS), F.floor(n * 0.2).cast("int"))
    seasonal, train = n >= 4 * SEASON, n - held
    enough = train >= F.when(seasonal, 2 * SEASON).otherwise(2)
    per = _once(per, _held=held, _seasonal=seasonal, _enough=enough,
                _train=F.when(enough, F.slice(values, 1, F.greatest(train, F.lit(0)))),
                _test=F.when(enough, F.slice(values, F.greatest(train, F.lit(0)) + 1, held)))

    def run(values: str) -> Column:
        found = [smoothed(F.col(values), alpha, beta, gamma, s) for s in (True, False)]
        return F.when(F.col("_enough"), F.when(F.col("_seasonal"), found[0]).otherwise(found[1]))

    def further(state: str, steps: Column) -> Column:
        found = [ahead(F.col(state), steps, s) for s in (True, False)]
        return F.when(F.col("_enough"), F.when(F.col("_seasonal"), found[0]).otherwise(found[1]))

    per = _once(per, _full=run("_values"), _part=run("_train"))
    per = _once(per, values=further("_full", F.lit(horizon)), _guess=further("_part", F.col("_held")))
    misses = F.filter(
        F.zip_with("_test", "_guess", lambda t, g: F.abs(C.ratio(t - g, t)) * 100), lambda x: x.isNotNull())
    errors, squares = F.col("_full.errors"), F.col("_full.squares")
    variance = C.ratio(squares - errors * errors / n, n - 1)
    return per.select(
        *keys, "points", _mean(misses).alias("mape"),
        F.when(variance.isNotNull(), F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("sigma"), "values")
