"""Keep one row per key, first or last in feed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Place in the feed, and number of the record in its file (where the feed comes from files).
ROW_INDEX, FILE_ROW = "row_index", "file_row"
POINTER = (ROW_INDEX, "source_file", FILE_ROW)


def dedup(df: DataFrame, keys: Sequence[str | Column], keep: str = "first",
          order_by: Sequence[str] = (ROW_INDEX,)) -> DataFrame:
    """One row per key. NULL keys count as equal.

    `row_number() = 1` lets Spark cut every key to one row per task before the shuffle
    (WindowGroupLimit), so a key that holds much of the data does not end up in one task.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be first or last, got {keep}")
    order = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order_by]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
