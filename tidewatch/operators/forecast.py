"""Forecasts of daily series: ridge on calendar features, linear, naive and Holt-Winters.

The forecast of any number of series is one job. Fitting is aggregation per key; Python
only solves 9x9 systems (ridge) and runs the smoothing recursion of one series (Holt-Winters).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.functions.timeparts import FEATURES, time_features
from tidewatch.operators import series as S

MIN_POINTS = 7
SEASON = 7


def check_horizon(horizon: int, lo: int = 7, hi: int = 90) -> int:
    if not lo <= horizon <= hi:
        raise ValueError(f"horizon must be between {lo} and {hi} days, got {horizon}")
    return horizon


def require_points(series: DataFrame, minimum: int = MIN_POINTS) -> DataFrame:
    """Raise for a lone series that is too short; runs a job that reads at most a few rows."""
    if series.limit(minimum).count() < minimum:
        raise ValueError(f"Need at least {minimum} data points to forecast")
    return series


def too_short(series: DataFrame, by: Sequence[str], minimum: int = MIN_POINTS) -> DataFrame:
    """The series that a forecast leaves out, with the reason."""
    return series.groupBy(*by).agg(F.count("*").alias("points")).filter(
        F.col("points") < minimum
    ).withColumn("error", F.lit(f"Need at least {minimum} data points to forecast"))


# --- ridge ------------------------------------------------------------------------
def feature_frame(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The nine calendar features of every day, t counted from the start of its series."""
    start = F.min("ds").over(S.whole(by))
    return series.withColumns(time_features(F.col("ds"), start))


def solver(alpha: float):
    """Pandas UDF for (X'X + alpha I)^-1 X'y over a batch of series."""

    @F.pandas_udf("array<double>")
    def solve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for gram, moments in batches:
            size = len(FEATURES)
            a = np.stack(gram.to_numpy()).reshape(-1, size, size) + alpha * np.eye(size)
            b = np.stack(moments.to_numpy())[..., None]
            yield pd.Series(list(np.linalg.solve(a, b)[..., 0]))

    return solve


def _dot(coefficients: Column, values: Column) -> Column:
    pairs = F.zip_with(coefficients, values, lambda b, v: b * v)
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.size(values)


def fit_ridge(series: DataFrame, keys: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """One model row per series of at least seven points, with its standardised history.

    The history travels in the model row as an array (a row per calendar day at most), so the
    series is read once and nothing has to be joined back.
    """
    w = S.whole(keys)
    known = F.nanvl("y", F.lit(None).cast("double"))
    rows = feature_frame(series, keys).withColumn("y", F.coalesce(known, F.avg(known).over(w)))
    stats = {}
    for f in FEATURES:
        deviation = F.stddev_pop(f).over(w)
        stats[f"_m_{f}"] = F.avg(f).over(w)
        stats[f"_s_{f}"] = F.when(deviation > 1e-12, deviation).otherwise(1.0)
    rows = rows.withColumns(
        {**stats, "_mean": F.avg("y").over(w), "_n": F.count("y").over(w)}
    ).filter(F.col("_n") >= MIN_POINTS)
    rows = rows.withColumns(
        {f"_z_{f}": (F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}") for f in FEATURES})

    z = [F.col(f"_z_{f}") for f in FEATURES]
    residual = F.col("y") - F.col("_mean")
    day = F.struct("ds", "y", F.array(*z).alias("z"))
    return rows.groupBy(*keys).agg(
        F.array(*[F.sum(a * b) for a in z for b in z]).alias("_gram"),
        F.array(*[F.sum(a * residual) for a in z]).alias("_moments"),
        F.array(*[F.first(f"_m_{f}") for f in FEATURES]).alias("_means"),
        F.array(*[F.first(f"_s_{f}") for f in FEATURES]).alias("_stds"),
        F.first("_mean").alias("_mean"), F.min("ds").alias("_start"), F.max("ds").alias("_last"),
        F.collect_list(day).alias("_days"),
    ).withColumn("_beta", solver(alpha)("_gram", "_moments")).drop("_gram", "_moments")


def ridge_forecast(
    series: DataFrame, by: Sequence[str] = (), horizon: int = 30, confidence: float = 0.95,
    extrapolate_trend: bool = False,
) -> DataFrame:
    """Fitted history and `horizon` future days with a normal band.

    History is as fitted, the future is not below 0. By default t starts over on the first
    future day, so the trend itself is not carried on; `extrapolate_trend` counts it from the
    start of the series. Series of fewer than seven points are left out (see `too_short`).
    """
    check_horizon(horizon)
    keyed, keys = S.keyed(series, by)
    model = fit_ridge(keyed, keys)
    beta, mean = F.col("_beta"), F.col("_mean")
    fitted = F.transform("_days", lambda d: F.struct(
        d["ds"].alias("ds"), (mean + _dot(beta, d["z"])).alias("p"), d["y"].alias("y")))
    model = model.withColumn("_fitted", fitted).withColumn(
        "_off", F.transform("_fitted", lambda d: d["y"] - d["p"]))
    off = F.col("_off")
    model = model.withColumn("_bias", _mean(off)).withColumns({
        "_sigma": F.sqrt(_mean(F.transform(off, lambda r: F.pow(r - F.col("_bias"), F.lit(2.0))))),
        "mae": _mean(F.transform(off, lambda r: F.abs(r))),
        "rmse": F.sqrt(_mean(F.transform(off, lambda r: r * r))),
    })
    margin = F.lit(1.96 if confidence >= 0.95 else 1.645) * F.col("_sigma")

    def point(ds: Column, p: Column, future: bool) -> Column:
        def cut(c: Column) -> Column:
            return F.greatest(c, F.lit(0.0)) if future else c

        return F.struct(
            ds.alias("ds"), cut(p).alias("predicted"), cut(p - margin).alias("lower_bound"),
            cut(p + margin).alias("upper_bound"), F.lit(future).alias("is_forecast"))

    def ahead(step: Column) -> Column:
        ds = F.date_add("_last", step)
        start = F.col("_start") if extrapolate_trend else F.date_add("_last", 1)
        raw = F.array(*time_features(ds, start).values())
        shifted = F.zip_with(raw, F.col("_means"), lambda v, m: v - m)
        scaled = F.zip_with(shifted, F.col("_stds"), lambda v, d: v / d)
        return point(ds, mean + _dot(beta, scaled), True)

    points = F.concat(
        F.transform("_fitted", lambda d: point(d["ds"], d["p"], False)),
        F.transform(F.sequence(F.lit(1), F.lit(horizon)), ahead))
    rows = model.select(*keys, F.explode(points).alias("_point"), "mae", "rmse").select(
        *keys, "_point.*", "mae", "rmse", F.lit(V.METHOD_RIDGE).alias("model_type"),
        F.lit(confidence).alias("confidence_interval"))
    return rows if by else rows.drop("_series")


# --- Holt-Winters -----------------------------------------------------------------------
def smooth(y: np.ndarray, horizon: int, seasonal: bool, grids: list[np.ndarray]):
    """Run the additive recursion for every (alpha, beta, gamma) of the grids at once.

    Returns the parameters, fitted values and forecast with the least squared error.
    """
    alpha, beta, gamma = (g.ravel() for g in np.meshgrid(*grids, indexing="ij"))
    m = SEASON if seasonal else 1
    if seasonal:
        first, second = y[:m].mean(), y[m:2 * m].mean()
        level, trend = np.full(alpha.size, first), np.full(alpha.size, (second - first) / m)
        season = np.tile(y[:m] - first, (alpha.size, 1))
    else:
        level, trend = np.full(alpha.size, y[0]), np.full(alpha.size, y[1] - y[0])
        season = np.zeros((alpha.size, 1))
    fitted = np.empty((len(y), alpha.size))
    for t, value in enumerate(y):
        s = season[:, t % m].copy()
        fitted[t] = level + trend + s
        new_level = alpha * (value - s) + (1 - alpha) * (level + trend)
        trend = beta * (new_level - level) + (1 - beta) * trend
        if seasonal:
            season[:, t % m] = gamma * (value - new_level) + (1 - gamma) * s
        level = new_level
    best = int(np.argmin(((y[:, None] - fitted) ** 2).sum(axis=0)))
    steps = np.arange(1, horizon + 1)
    places = (len(y) + steps - 1) % m
    ahead = level[best] + steps * trend[best] + season[best, places]
    return (alpha[best], beta[best], gamma[best]), fitted[:, best], ahead


def holt_winters(y: np.ndarray, horizon: int, seasonal: bool):
    """Smoothing with parameters from a coarse grid that is refined twice around its best."""
    width, grids = 0.25, [np.linspace(0.05, 0.95, 5)] * 2
    grids = grids + [np.linspace(0.05, 0.95, 5) if seasonal else np.zeros(1)]
    for _ in range(3):
        best, fitted, ahead = smooth(y, horizon, seasonal, grids)
        width /= 3
        grids = [np.unique(np.clip([b - width, b, b + width], 0.001, 0.999)) for b in best]
        if not seasonal:
            grids[2] = np.zeros(1)
    return fitted, ahead


SMOOTHED = T.StructType([
    T.StructField("mape", T.DoubleType()), T.StructField("sigma", T.DoubleType()),
    T.StructField("values", T.ArrayType(T.DoubleType())),
])


@F.pandas_udf(SMOOTHED)
def fit_holt_winters(history: pd.Series, horizon: pd.Series) -> pd.DataFrame:
    """Additive trend, weekly season from 28 points on; error measured on the last fifth.

    Gives NULLs for series that are too short to be fitted.
    """
    rows = []
    for values, days in zip(history, horizon):
        y = np.asarray(values, dtype=float)
        held = max(MIN_POINTS, int(len(y) * 0.2))
        seasonal = len(y) >= 4 * SEASON
        train, test = y[:-held], y[-held:]
        if len(train) < (2 * SEASON if seasonal else 2):
            rows.append((None, None, None))
            continue
        _, guess = holt_winters(train, held, seasonal)
        known = test != 0
        mape = np.mean(np.abs((test[known] - guess[known]) / test[known])) * 100 if known.any() else None
        fitted, ahead = holt_winters(y, int(days), seasonal)
        rows.append((mape, np.std(y - fitted, ddof=1), ahead.tolist()))
    return pd.DataFrame(rows, columns=["mape", "sigma", "values"])


# --- one model row per series ------------------------------------------------------------
def _horizon_values(horizon: int, value) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), value)


def detect_trend(values: Column, horizon: int) -> Column:
    """up or down when the second half of the horizon is 5 % off the first."""
    if horizon < 2:
        return F.lit("flat")
    half = horizon // 2
    first = _mean(F.slice(values, 1, half))
    second = _mean(F.slice(values, half + 1, horizon - half))
    change = (second - first) / (first + 1e-9)
    return F.when(change > 0.05, "up").when(change < -0.05, "down").otherwise("flat")


def model_frame(series: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """Everything the models need, one row per series, from one pass over the series.

    linear: least squares over the position in the series (gaps in the dates do not count).
    naive: the mean. The history is kept as an array; a series has a row per day at most.
    """
    w = S.whole(keys)
    latest = Window.partitionBy(*keys).orderBy(F.desc("ds"))
    rows = series.filter(F.col("y").isNotNull()).withColumns({
        "_i": S.position(keys), "_back": F.row_number().over(latest)})
    rows = rows.withColumns({
        "_slope": F.regr_slope("y", "_i").over(w), "_icept": F.regr_intercept("y", "_i").over(w)})
    off = F.col("y") - (F.col("_slope") * F.col("_i") + F.col("_icept"))
    per = rows.groupBy(*keys).agg(
        F.count("*").alias("points"), F.max("ds").alias("last_ds"),
        F.avg(F.when(F.col("_back") <= 7, F.col("y"))).alias("recent_avg"),
        F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("history"),
        F.first("_slope").alias("_slope"), F.first("_icept").alias("_icept"),
        F.stddev_pop(off).alias("_linear_sigma"), F.avg("y").alias("_mean"),
        F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("_naive_sigma"))
    slope = F.col("_slope")
    return per.withColumns({
        "_linear_values": _horizon_values(
            horizon, lambda i: slope * (F.col("points") + i) + F.col("_icept")),
        "_naive_values": _horizon_values(horizon, lambda i: F.col("_mean")),
        "_linear_trend": F.when(slope > 0.1, "up").when(slope < -0.1, "down").otherwise("flat"),
    })


MODEL_COLUMNS = ["points", "last_ds", "recent_avg", "history", "sigma", "methodology", "mape",
                 "trend_direction", "values"]


def run_forecast(
    series: DataFrame, by: Sequence[str] = (), horizon: int = 30, smoothing: bool = False
) -> DataFrame:
    """One model row per series: naive below seven points, else linear or Holt-Winters.

    With `smoothing`, series that Holt-Winters cannot fit fall back to the linear trend.
    """
    check_horizon(horizon)
    keyed, keys = S.keyed(series, by)
    per = model_frame(keyed, keys, horizon)
    short = F.col("points") < MIN_POINTS
    if smoothing:
        fit = fit_holt_winters(F.transform("history", lambda d: d["y"]), F.lit(horizon))
        per = per.withColumn("_smooth", fit)
        fitted = ~short & F.col("_smooth.values").isNotNull()
        mape, smooth_sigma, smooth_values = (F.col(f"_smooth.{n}") for n in ("mape", "sigma", "values"))
    else:
        fitted, mape, smooth_sigma, smooth_values = F.lit(False), F.lit(None), F.lit(None), None

    def choose(naive, smooth, linear):
        chain = F.when(short, naive)
        if smoothing:
            chain = chain.when(fitted, smooth)
        return chain.otherwise(linear)

    trend = detect_trend(smooth_values, horizon) if smoothing else None
    models = per.withColumns({
        "sigma": choose(F.col("_naive_sigma"), smooth_sigma, F.col("_linear_sigma")),
        "methodology": choose(F.lit(V.METHOD_NAIVE), F.lit(V.METHOD_HOLT_WINTERS), F.lit(V.METHOD_LINEAR)),
        "mape": F.round(F.when(fitted, mape).cast("double"), 1),
        "trend_direction": choose(F.lit("flat"), trend, F.col("_linear_trend")),
        "values": choose(F.col("_naive_values"), smooth_values, F.col("_linear_values")),
    }).select(*keys, *MODEL_COLUMNS)
    return models if by else models.drop("_series")


def forecast_ticket_volume(series: DataFrame, by: Sequence[str] = (), horizon: int = 30, **options):
    models = run_forecast(series, by, horizon, **options)
    return summarize(models, "ticket_volume", horizon)


def forecast_demand(series: DataFrame, by: Sequence[str] = (), horizon: int = 30, **options):
    models = run_forecast(series, by, horizon, **options)
    return summarize(models, "demand", horizon)


def build_points(
    models: DataFrame, by: Sequence[str] = (), history: int | None = 60
) -> DataFrame:
    """The last `history` actual days (None: all) and the horizon, whose band widens by 2 % per day."""
    def at_zero(c: Column) -> Column:
        return F.round(F.greatest(c, F.lit(0.0)), 2)

    def past(d: Column) -> Column:
        y = F.round(d["y"], 2)
        return F.struct(d["ds"].alias("ds"), y.alias("forecast"), y.alias("lower_ci"),
                        y.alias("upper_ci"), F.lit(True).alias("is_actual"), y.alias("actual"))

    def ahead(value: Column, i: Column) -> Column:
        band = F.lit(1.96) * F.col("sigma") * (1 + i * 0.02)
        return F.struct(
            F.date_add("last_ds", i + 1).alias("ds"), at_zero(value).alias("forecast"),
            at_zero(value - band).alias("lower_ci"), at_zero(value + band).alias("upper_ci"),
            F.lit(False).alias("is_actual"), F.lit(None).cast("double").alias("actual"))

    recent = F.col("history")
    if history is not None:
        start = F.greatest(F.size("history") - (history - 1), F.lit(1))
        recent = F.slice("history", start, history)
    points = F.concat(F.transform(recent, past), F.transform("values", ahead))
    return models.select(*by, F.explode(points).alias("_point")).select(*by, "_point.*")


def summarize(models: DataFrame, metric: str, horizon: int) -> DataFrame:
    """Add the sentence on the expected change against the last seven days."""
    mean = _mean(F.col("values"))
    recent = F.col("recent_avg")
    pct = (mean - recent) / (recent + 1e-9) * 100
    title = C.title_case(F.lit(metric.replace("_", " ")))
    text = F.format_string(
        V.FORECAST_SUMMARY, title, F.when(pct > 0, "increase").otherwise("decrease"),
        C.fixed(F.abs(pct), 1), F.lit(horizon), C.fixed(recent, 1), C.fixed(mean, 1),
        F.col("trend_direction"))
    naive = F.format_string(V.FORECAST_SUMMARY_NAIVE, C.fixed(F.col("values")[0], 1))
    return models.withColumns({
        "metric": F.lit(metric), "horizon_days": F.lit(horizon),
        "summary": F.when(F.col("methodology") == V.METHOD_NAIVE, naive).otherwise(text),
    })
