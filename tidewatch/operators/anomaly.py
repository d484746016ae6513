"""Anomalies of daily series: rolling z-score, interquartile range and multivariate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.operators import forest
from tidewatch.operators import series as S


# --- causes -----------------------------------------------------------------------
def infer_cause(metric: Column, observed: Column, expected: Column, z: Column) -> Column:
    """Sentence for a flagged value, by metric, direction and size."""
    size = F.when(F.abs(z) > 3.5, "Significant").otherwise("Notable")
    spike = observed > expected

    def sentence(template: str) -> Column:
        return F.format_string(template, size) if "%s" in template else F.lit(template)

    up, down = V.CAUSE_DEFAULT
    other = F.when(spike, F.concat(sentence(up), metric)).otherwise(
        F.concat(sentence(down), metric))
    chain = None
    for name, (on_spike, on_drop) in V.CAUSES.items():
        text = F.when(spike, sentence(on_spike)).otherwise(sentence(on_drop))
        chain = F.when(metric == name, text) if chain is None else chain.when(metric == name, text)
    return chain.otherwise(other)


def zscore_severity(z: Column) -> Column:
    return (
        F.when(F.abs(z) > 4.0, "critical").when(F.abs(z) > 3.5, "high")
        .when(F.abs(z) > 3.0, "medium").otherwise("low")
    )


def _metric(metric: str | Column) -> Column:
    return F.lit(metric) if isinstance(metric, str) else metric


def _keys(by: Sequence[str], metric: str | Column) -> list:
    """Key columns, day and metric of a finding; the metric may be one of the keys."""
    keys = [F.col(k) for k in by if k != "metric"]
    return [*keys, F.col("ds").alias("date"), _metric(metric).alias("metric")]


# --- rolling z-score -----------------------------------------------------------------
def _neighbours(by: Sequence[str]) -> tuple[Column, Column]:
    """Mean and deviation of the three rows before and the three after, together.

    The two sides are combined by their counts, means and variances, which stays exact for
    flat neighbours where sums of squares would leave rounding noise.
    """
    sides = [S.in_order(by).rowsBetween(-3, -1), S.in_order(by).rowsBetween(1, 3)]
    (n1, m1, v1), (n2, m2, v2) = [
        (F.count("y").over(w), F.coalesce(F.avg("y").over(w), F.lit(0.0)),
         F.coalesce(F.var_pop("y").over(w), F.lit(0.0))) for w in sides]
    n = n1 + n2
    rows = F.when(n > 0, n)
    mean = (n1 * m1 + n2 * m2) / rows
    squares = n1 * v1 + n2 * v2 + (m1 - m2) * (m1 - m2) * n1 * n2 / rows
    std = F.sqrt(squares / F.when(n > 1, n - 1))
    return S.at_least(n, 3, mean), S.at_least(n, 3, S.spread(std))


def zscore_anomalies(
    series: DataFrame, metric: str | Column, threshold: float = 2.5, by: Sequence[str] = (),
    baseline: str = "centered",
) -> DataFrame:
    """Values at least `threshold` deviations off the mean of the seven rows around them.

    centered: the window holds the value itself, so |z| stays below 2.27 and a threshold above
    that finds nothing. exclude_self: mean and deviation of the six neighbours.
    Series of fewer than seven rows give nothing.
    """
    if baseline == "centered":
        mean, std = S.rolling_mean(by), S.rolling_std(by)
    elif baseline == "exclude_self":
        mean, std = _neighbours(by)
    else:
        raise ValueError(f"baseline must be centered or exclude_self, got {baseline}")
    scored = series.withColumns({
        "expected_value": mean, "_std": std, "_n": F.count("y").over(S.whole(by)),
    }).withColumn("z_score", (F.col("y") - F.col("expected_value")) / F.col("_std"))
    z = F.col("z_score")
    return scored.filter((F.col("_n") >= 7) & (F.abs(z) >= threshold)).select(
        *_keys(by, metric), F.col("y").alias("observed_value"), "expected_value", "z_score",
        zscore_severity(z).alias("severity"),
        infer_cause(_metric(metric), F.col("y"), F.col("expected_value"), z).alias("likely_cause"),
        F.create_map(F.lit("rolling_window"), F.lit(7.0), F.lit("threshold"),
                     F.lit(float(threshold))).alias("correlated_fields"),
    )


# --- interquartile range ----------------------------------------------------------------
def iqr_anomalies(
    series: DataFrame, metric: str | Column, multiplier: float = 1.5, by: Sequence[str] = ()
) -> DataFrame:
    """Values outside the quartile fences. Series of fewer than four rows give nothing."""
    quartiles = F.percentile("y", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(S.whole(by))
    q = series.withColumns({"_q": quartiles, "_n": F.count("y").over(S.whole(by))}).withColumns({
        "q1": F.col("_q")[0], "median": F.col("_q")[1], "q3": F.col("_q")[2],
        "iqr": F.col("_q")[2] - F.col("_q")[0],
    })
    y, iqr, median = F.col("y"), F.col("iqr"), F.col("median")
    outside = (y < F.col("q1") - multiplier * iqr) | (y > F.col("q3") + multiplier * iqr)
    z = F.abs(y - median) / (iqr / 1.35 + 1e-9)
    return q.filter((F.col("_n") >= 4) & outside).withColumn("_z", z).select(
        *_keys(by, metric), y.alias("observed_value"), median.alias("expected_value"),
        F.round("_z", 2).alias("z_score"),
        F.when(F.col("_z") < 3.5, "medium").otherwise("high").alias("severity"),
        infer_cause(_metric(metric), y, median, F.col("_z")).alias("likely_cause"),
        F.create_map(F.lit("q1"), F.col("q1"), F.lit("q3"), F.col("q3"), F.lit("iqr"), iqr)
        .alias("correlated_fields"),
    )


# --- multivariate --------------------------------------------------------------------------
def zscore_labels(
    daily: DataFrame, primary: str, contamination: float = 0.05, by: Sequence[str] = ()
) -> DataFrame:
    """Score every day by its distance from the mean; flag the top share `contamination`.

    The score is negative: the lower, the more unusual.
    """
    w = S.whole(by)
    z = F.abs((F.col(primary) - F.avg(primary).over(w)) / (F.stddev_samp(primary).over(w) + 1e-9))
    scored = daily.withColumn("_z", z)
    limit = F.percentile("_z", F.lit(1 - contamination)).over(w)
    return scored.withColumn("_limit", limit).withColumns({
        "is_anomaly": F.col("_z") >= F.col("_limit") - 1e-12, "anomaly_score": -F.col("_z"),
    }).drop("_z", "_limit")


def infer_reasons(
    context: str, value: Column, mean: Column, std: Column, z: Column, fields: dict[str, Column]
) -> Column:
    """Sentences that explain a flagged day."""
    def given(name):
        return F.coalesce(fields.get(name, F.lit(None)).cast("double"), F.lit(0.0))

    if context == "tickets":
        rules = [
            F.when(value > mean + 2 * std, F.lit(V.REASON_TICKETS_HIGH)),
            F.when(given("critical_count") > 0, F.format_string(
                V.REASON_TICKETS_CRITICAL, given("critical_count").cast("long"))),
            F.when(given("sla_breaches") > mean * 0.3, F.lit(V.REASON_TICKETS_BREACHES)),
        ]
    elif context == "workforce":
        rules = [
            F.when(value < mean - 2 * std, F.lit(V.REASON_WORKFORCE_LOW)),
            F.when(given("absent_count") > 0, F.format_string(
                V.REASON_WORKFORCE_ABSENT, given("absent_count").cast("long"))),
            F.when(given("overtime_hours") > mean * 1.5, F.lit(V.REASON_WORKFORCE_OVERTIME)),
        ]
    else:
        raise ValueError(f"context must be tickets or workforce, got {context}")
    found = F.array_compact(F.array(*rules))
    side = F.when(value > mean, "above").otherwise("below")
    other = F.array(F.format_string(V.REASON_OTHER, side, C.fixed(z, 1)))
    return F.when(F.size(found) > 0, found).otherwise(other)


def multivariate_anomalies(
    daily: DataFrame, primary: str, context: str, features: Sequence[str],
    contamination: float = 0.05, by: Sequence[str] = (), method: str = "forest",
) -> DataFrame:
    """Unusual days over several measures; `daily` has one row per key and `date`.

    forest scores all features with an isolation forest; zscore looks at `primary` alone.
    Series of fewer than ten days give nothing. Sort by `anomaly_score`, lowest first.
    """
    w = S.whole(by)
    days = daily.withColumn("_days", F.count(F.lit(1)).over(w)).filter("_days >= 10")
    if method == "forest":
        scored = forest.isolation_scores(days, features, by)
        limit = F.percentile("anomaly_score", F.lit(contamination)).over(w)
        scored = scored.withColumn("_limit", limit).withColumn(
            "is_anomaly", F.col("anomaly_score") < F.col("_limit")).drop("_limit")
    elif method == "zscore":
        scored = zscore_labels(days, primary, contamination, by)
    else:
        raise ValueError(f"method must be forest or zscore, got {method}")

    scored = scored.withColumns({
        "_mean": F.avg(primary).over(w), "_std": F.stddev_samp(primary).over(w),
    })
    value, mean, std = F.col(primary).cast("double"), F.col("_mean"), F.col("_std")
    z = F.abs(value - mean) / (std + 1e-9)
    others = [c for c in features if c != primary]
    pairs = [F.when(F.col(c).isNotNull(), F.struct(
        F.lit(c).alias("key"), F.round(F.col(c).cast("double"), 2).alias("value"))) for c in others]
    entries = F.array(*pairs).cast("array<struct<key:string,value:double>>")
    correlated = F.map_from_entries(F.array_compact(entries))
    return scored.filter("is_anomaly").select(
        *by, "date", F.lit(primary).alias("metric"), F.round(value, 2).alias("observed_value"),
        F.struct(F.round(mean - 2 * std, 2).alias("lo"), F.round(mean + 2 * std, 2).alias("hi"))
        .alias("expected_range"),
        F.when(z > 3, "critical").otherwise("warning").alias("severity"),
        F.round("anomaly_score", 4).alias("anomaly_score"),
        infer_reasons(context, value, mean, std, z, {c: F.col(c) for c in others})
        .alias("likely_reasons"),
        correlated.alias("correlated_fields"), F.col("_days").alias("total_points"),
    )


def anomaly_summary(anomalies: DataFrame, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """One sentence per series on the flagged days, naming the first three critical ones.

    Without `by`, a frame without anomalies still gives its one row.
    """
    critical, warning = F.col("severity") == "critical", F.col("severity") == "warning"
    agg = [
        F.count("*").alias("anomalies"), F.count_if(critical).alias("critical"),
        F.count_if(warning).alias("warnings"),
        F.array_sort(F.collect_list(F.when(critical, F.col("date").cast("string")))).alias("_dates"),
        F.max("total_points").alias("total_points"),
    ]
    per = anomalies.groupBy(*by).agg(*agg) if by else anomalies.agg(*agg)
    n = F.col("anomalies")
    return per.select(
        *by, "anomalies", "critical", "warnings",
        F.round(F.coalesce(n / F.col("total_points"), F.lit(0.0)), 4).alias("anomaly_rate"),
        _sentence(metric).alias("summary"),
    )


def _sentence(metric: str) -> Column:
    """From the columns anomalies, critical, warnings and _dates (of the critical ones)."""
    n, crit, warn = F.col("anomalies"), F.col("critical"), F.col("warnings")
    dates = F.concat(F.array_join(F.slice("_dates", 1, 3), ", "),
                     F.when(crit > 3, "...").otherwise(""))
    parts = F.concat_ws(
        " ", F.format_string(f"Detected %d anomalies in {metric.replace('_', ' ')}:", n),
        F.when(crit > 0, F.format_string("%d critical (dates: %s)", crit, dates)),
        F.when(warn > 0, F.format_string("%d warnings", warn)),
    )
    return F.when(n == 0, F.lit(f"No anomalies detected in {metric}.")).otherwise(F.concat(parts, F.lit(".")))


def detector_reports(
    series: DataFrame, found: DataFrame, metric: str, method: str, minimum: int, by: Sequence[str] = ()
) -> DataFrame:
    """One row for every series that was looked at, with or without anomalies.

    total_points, anomalies, critical, warnings (all other severities), anomaly_rate, detection_method, summary. A
    series below `minimum` points has the method and the sentence of insufficient data; a quiet one says so. Without
    `by`, an empty series still gives its one row. Points and findings are counted in one grouping, without a join.
    """
    points = series.select(
        *by, F.lit(1).alias("_point"), F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("date").alias("date"))
    hits = found.select(*by, F.lit(0).alias("_point"), "severity", F.col("date").cast("date").alias("date"))
    rows = points.unionByName(hits)
    is_critical = F.col("severity") == "critical"
    agg = [
        F.coalesce(F.sum("_point"), F.lit(0)).cast("long").alias("total_points"),
        F.count("severity").alias("anomalies"), F.count_if(is_critical).alias("critical"),
        (F.count("severity") - F.count_if(is_critical)).alias("warnings"),
        F.array_sort(F.collect_list(F.when(is_critical, F.col("date").cast("string")))).alias("_dates"),
    ]
    per = rows.groupBy(*by).agg(*agg) if by else rows.agg(*agg)
    enough = F.col("total_points") >= minimum
    return per.select(
        *by, "total_points", "anomalies", "critical", "warnings",
        F.round(F.col("anomalies") / F.greatest(F.col("total_points"), F.lit(1)), 4).alias("anomaly_rate"),
        F.when(enough, method).otherwise(V.NO_METHOD).alias("detection_method"),
        F.when(~enough, V.NOT_ENOUGH % minimum).otherwise(_sentence(metric)).alias("summary"),
    )


# --- severity overview -------------------------------------------------------------------------
def severity_rank(severity: Column) -> Column:
    """critical 0, high 1, medium 2, low and anything else 3."""
    return F.coalesce(C.map_values(severity, {s: i for i, s in enumerate(V.SEVERITIES)}), F.lit(3))


def severity_counts(anomalies: DataFrame) -> DataFrame:
    """Count per severity, zero where there is none."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES]
    wide = anomalies.agg(*counts)
    return wide.unpivot([], V.SEVERITIES, "severity", "count")
