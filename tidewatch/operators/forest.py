"""Isolation forest over daily rows, built and scored as Spark jobs.

After Liu, Ting and Zhou, "Isolation Forest", ICDM 2008. Every (series, tree) pair is one
group of at most `sample` rows, 256 by default. Rows are scored in blocks of about BLOCK_ROWS,
each with a copy of its series' trees, so that a long series is no single task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import series as S

EULER = 0.5772156649
#: Rows of a series that are scored together.
BLOCK_ROWS = 512
TREE_FIELDS = ("feature array<int>, threshold array<double>, left array<int>, "
               "right array<int>, depth array<double>")


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One tree as parallel node lists; `depth` of a leaf is its path length."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "depth": []}

    def add(rows: np.ndarray, level: int) -> int:
        node = len(nodes["feature"])
        for values, empty in zip(nodes.values(), (-1, 0.0, -1, -1, level + mean_path(len(rows)))):
            values.append(empty)
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (0, 0)
        usable = np.flatnonzero(np.asarray(high) > np.asarray(low))
        if level >= limit or len(rows) <= 1 or not len(usable):
            return node
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = x[rows, f] <= cut
        nodes["feature"][node], nodes["threshold"][node] = f, cut
        nodes["left"][node] = add(rows[goes_left], level + 1)
        nodes["right"][node] = add(rows[~goes_left], level + 1)
        return node

    add(np.arange(len(x)), 0)
    return nodes


def path_lengths(x: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """Path length of every row, walking all rows down one level at a time."""
    at = np.zeros(len(x), dtype=int)
    while True:
        f = tree["feature"][at]
        inner = f >= 0
        if not inner.any():
            return tree["depth"][at]
        goes_left = x[np.arange(len(x)), np.maximum(f, 0)] <= tree["threshold"][at]
        below = np.where(goes_left, tree["left"][at], tree["right"][at])
        at = np.where(inner, below, at)


def likely_drawn(chance: str, rows: str, sample: int) -> Column:
    """Whether a row of a series of `rows` rows can be among the `sample` with the least 64-bit hash.

    Rows pass up to a share that holds 2 * sample + 64 of them on average: for a sample of 256 that is 13
    standard deviations more than wanted, so the draw stays the same and long series are not sorted.
    """
    share = F.least((F.lit(2.0) * sample + 64) / F.col(rows), F.lit(1.0))
    return (F.col(chance) / F.lit(2.0**64) + 0.5) <= share


def isolation_scores(
    daily: DataFrame, features: Sequence[str], by: Sequence[str] = (), trees: int = 100,
    sample: int = 256, seed: int = 42, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add `anomaly_score` in [-1, 0); the lower, the more unusual.

    Missing measures take the median of their series, then all are standardised. Every tree is
    grown from the `sample` rows of its series with the least hash of (seed, tree, date), all rows
    are scored; neither depends on `block_rows` or on how the rows are dealt to tasks.
    """
    daily, keys = S.keyed(daily, by, "date")
    w = S.whole(keys)
    filled = {f"_f_{f}": F.coalesce(
        F.col(f).cast("double"), F.median(F.col(f).cast("double")).over(w), F.lit(0.0))
        for f in features}
    points = daily.withColumns(filled)
    deviation = {f: F.stddev_pop(f).over(w) for f in filled}
    scaled = [(F.col(f) - F.avg(f).over(w)) / F.when(deviation[f] > 0, deviation[f]).otherwise(1.0)
              for f in filled]
    points = points.withColumn("x", F.array(*scaled)).drop(*filled)

    points = points.withColumn("_rows", F.count(F.lit(1)).over(w))
    chance = F.xxhash64(F.lit(seed), "tree", "date")
    numbered = points.select(*keys, "date", "x", "_rows", F.explode(
        F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    numbered = numbered.withColumn("_chance", chance).filter(likely_drawn("_chance", "_rows", sample))
    draw = Window.partitionBy(*keys, "tree").orderBy("_chance", "date")
    drawn = numbered.withColumn("_rank", F.row_number().over(draw)).filter(F.col("_rank") <= sample)
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                           for f in points.select(*keys).schema.fields)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rank")
        number = int(rows["tree"].iloc[0])
        tree = grow(np.stack(rows["x"].to_numpy()), np.random.default_rng([seed, number]))
        out = {k: [rows[k].iloc[0]] for k in [*keys, "tree", "_rows"]}
        return pd.DataFrame({**out, "size": [len(rows)], **{k: [v] for k, v in tree.items()}})

    grown = drawn.groupBy(*keys, "tree").applyInPandas(
        build, f"{key_fields}, tree int, _rows long, size int, {TREE_FIELDS}")

    def score(rows: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        out = rows.drop(columns=["x", "_block"])
        if rows.empty or forest.empty:
            return out.assign(anomaly_score=np.zeros(len(out)))
        x = np.stack(rows["x"].to_numpy())
        names = ("feature", "threshold", "left", "right", "depth")
        total = np.zeros(len(x))
        for tree in forest.sort_values("tree")[list(names)].itertuples(index=False):
            total += path_lengths(x, {n: np.asarray(v) for n, v in zip(names, tree)})
        depth = total / len(forest)
        norm = max(mean_path(float(forest["size"].iloc[0])), 1e-9)
        return out.assign(anomaly_score=-np.power(2.0, -depth / norm))

    blocks = F.ceil(F.col("_rows") / block_rows).cast("int")
    dealt = points.withColumn("_block", F.pmod(F.hash("date"), blocks)).drop("_rows")
    copies = grown.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    schema = T.StructType([*daily.schema.fields, T.StructField("anomaly_score", T.DoubleType())])
    scored = dealt.groupBy(*keys, "_block").cogroup(copies.groupBy(*keys, "_block")).applyInPandas(score, schema)
    return scored if by else scored.drop("_series")
