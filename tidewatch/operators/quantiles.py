"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_brackets(value: Column, p: float, accuracy: int) -> tuple[Column, Column, Column]:
    """Aggregates for `exact_percentile`: row count and two values around the percentile.

    The sketch is off by at most 1/accuracy of the rows, so three times that on either
    side encloses both ranks the percentile is interpolated between. Where that is less
    than three ranks, the group is small enough to be enclosed as a whole.
    """
    margin = 3.0 / accuracy
    n = F.count(value)
    bounds = F.percentile_approx(
        value, F.array(F.lit(max(0.0, p - margin)), F.lit(min(1.0, p + margin))), F.lit(accuracy)
    )
    small = n * F.lit(margin) < 3
    low = F.when(small, F.min(value)).otherwise(bounds[0])
    high = F.when(small, F.max(value)).otherwise(bounds[1])
    return n, low, high


def exact_percentile(
    df: DataFrame, brackets: DataFrame, by: Sequence[str], value: str, p: float, name: str,
    few_groups: bool = False,
) -> DataFrame:
    """`percentile_cont(p)` of `value` per group, exact, without holding a group in memory.

    `brackets` has one row per group with `_n`, `_low` and `_high` of `percentile_brackets`.
    Spark's own `percentile` keeps every distinct value of a group in one task. Here rows
    outside the bracket are only counted (combined before the shuffle), and the few inside
    are counted per value, so the sorted part per group is about 6/accuracy of its rows.
    A bracket that missed its ranks would raise an error rather than give a wrong number.

    `few_groups`: set it only where the groups are a fixed list; the brackets are then
    broadcast instead of leaving the choice of the join to Spark.
    """
    side = F.broadcast(brackets) if few_groups else brackets
    pairs = [F.col(f"v.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    joined = df.filter(F.col(value).isNotNull()).alias("v").join(side.alias("b"), pairs)
    x = F.col(f"v.{value}")
    inside = F.when(x.between(F.col("b._low"), F.col("b._high")), x)
    keys = [F.col(f"v.{k}").alias(k) for k in by]
    counted = joined.groupBy(*keys, inside.alias("_x")).agg(
        F.count("*").alias("_rows"),
        F.count_if(x < F.col("b._low")).alias("_below"),
        F.max("b._n").alias("_n"),
    )
    group = Window.partitionBy(*by)
    below = F.sum("_below").over(group)
    upto = F.sum(F.when(F.col("_x").isNotNull(), F.col("_rows"))).over(
        group.orderBy(F.col("_x").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.withColumns({"_less": below, "_upto": below + upto}).filter("_x is not null")
    h = (F.col("_n") - 1) * F.lit(p)
    # ranks count from 0: the value of rank r is the first one with more than r rows up to it
    found = ranked.groupBy(*by).agg(
        F.min(F.when(F.col("_upto") > F.floor(h), F.col("_x"))).alias("_v0"),
        F.min(F.when(F.col("_upto") > F.ceil(h), F.col("_x"))).alias("_v1"),
        F.max("_less").alias("_less"), F.max("_n").alias("_n"),
    )
    missed = F.col("_v1").isNull() | (F.col("_less") > F.floor(h))
    exact = F.col("_v0") + (h - F.floor(h)) * (F.col("_v1") - F.col("_v0"))
    return found.select(
        *by, F.when(missed, F.raise_error("percentile bracket missed").cast("double"))
        .otherwise(exact).alias(name)
    )
