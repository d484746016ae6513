"""Shared pieces of the text operators: registry, given tables, tables in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import work_dir

Query = Callable[[SparkSession, str], DataFrame]

_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; `oracle` is DuckDB SQL for the same rows, where SQL can express them."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: short lineage, stable row ids.

    The table is in the folder that spark.checkpoint.dir names, so every executor sees it and a
    lost executor costs nothing but the tasks it was running. Shuffle files of the job go as soon as the
    table is written, the table with `release` or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialise` gave, once nothing is left to be computed from them."""
    for df in tables:
        folder, files = _folder(df.sparkSession, _WRITTEN.pop(df))
        files.delete(folder, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for the jobs that run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def arrow_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows in the jobs that run inside; rows of long texts are large."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Rows of whole texts in an Arrow batch, which the JVM and the Python worker both hold.
TEXT_ROWS = 500


def give_back() -> None:
    """What this Python worker has freed goes back to the system: workers outlive their tasks, also idle ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def giving_back(run):
    """`run`, a function over Arrow batches, whose worker gives its free memory back at the end of the task."""

    @wraps(run)
    def task(batches):
        yield from run(batches)
        give_back()

    return task


def join_counted(rows: DataFrame, small: DataFrame, key: str, limit: int = 50_000, salts: int = 32) -> DataFrame:
    """`rows` with the columns of `small` (a written table, one row of fixed width for each key).

    Up to `limit` rows of `small` are broadcast, a few megabytes; with more the join is a shuffle in
    which every row of `small` goes to `salts` places, so that a key that holds a large share of `rows` is
    split. Rows without a match have NULL columns.
    """
    if small.count() <= limit:
        return rows.join(F.broadcast(small), key, "left")
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [key, "__salt"], "left").drop("__salt")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with a column rank: 1, 2, 3, ... over the whole table in `order`, without one task that sees all.

    Rows are dealt by range and sorted within the ranges, written with their place, and each range's
    place is moved by the rows before it. `rows` must come from a written table. Rows that `order` does not tell apart get ranks in any order.
    """
    spread = [*order, F.col("__row")]
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *spread).sortWithinPartitions(*spread)
    placed = dealt.drop("__row").withColumn("__place", F.monotonically_increasing_id())
    placed = placed.withColumn("__range", F.shiftright("__place", 33))
    placed = materialise(placed.withColumn("__place", F.col("__place").bitwiseAND(2**33 - 1)), name)
    ranges = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    joined = placed.join(F.broadcast(ranges), "__range")  # one row for each range
    rank = F.col("__before") + F.col("__place") + 1
    return joined.withColumn("rank", rank.cast("long")).drop("__range", "__place", "__before")
