"""Continuous ingestion: a landing folder of feed files into the warehouse.

The file source remembers which files it has read, and every micro-batch is loaded by the same code, and in the
same layout, as a batch load, under the commit name `<stream>-<number>`. A batch that is run again after a
failure skips what it has written. So each file counts once, with exactly one audit row per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.operators import loading
from tidewatch.operators.dedup import ROW_INDEX
from tidewatch.plans import ingest
from tidewatch.sources.warehouse import Warehouse


#: Where in the landing folder a row was read.
SPLIT = "_split"


def feed_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def landing_stream(
    spark: SparkSession, folder: str, names: list[str], files_per_batch: int | None = None
) -> DataFrame:
    """CSV files of one feed as a stream; the schema is fixed, as streams require."""
    reader = spark.readStream.schema(feed_schema(names)).option("header", True).option(
        "enforceSchema", False).option("escape", '"')
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder).select(
        "*", F.col("_metadata.file_name").alias("source_file"),
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias(SPLIT))


def _feed(batch_rows: DataFrame, order_by: str | None) -> DataFrame:
    """The batch with its feed order: a numeric column, or the place in the files (file, split, place in it)."""
    place = F.col(order_by).cast("long") if order_by else F.struct(SPLIT, F.monotonically_increasing_id())
    return batch_rows.withColumn(ROW_INDEX, place).drop(SPLIT, order_by or SPLIT)


def start_feed_stream(
    stream: DataFrame, store: Warehouse, source_type: str, as_of: str | Callable[[], str], checkpoint: str,
    order_by: str | None = None, name: str = "stream",
) -> StreamingQuery:
    """Clean every micro-batch and write facts, dimensions, rejected rows and one audit row.

    Tickets are inserted only when no earlier load holds their id (`left_anti` over the id
    column alone, so a long history costs a scan of one column). `as_of` may be a function, which is asked for each
    batch. `order_by` names a numeric column that gives the feed order; without it, the files and the order
    in them are taken. `name` tells the commits of several streams into one warehouse apart.
    """

    def load(batch_rows: DataFrame, batch: int) -> None:
        now = as_of() if callable(as_of) else as_of
        commit = f"{name}-{batch}"
        feed = _feed(batch_rows, order_by)
        feed = feed.withColumns({
            n: C.na_to_null(F.col(n), V.NA_TOKENS)
            for n, t in feed.dtypes if t == "string" and n != "source_file"
        })
        summary = ingest.ingest_feed(store, feed, source_type, commit, now, now, commit=commit)
        audit = summary.select(F.lit(commit).alias("run_id"), "*", F.lit(now).cast("timestamp_ntz").alias("started_at"))
        store.merge("ingestion_run", audit, "run_id", loading.run_states, commit)

    return (
        stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def start_record_stream(
    stream: DataFrame, store: Warehouse, dataset: str, checkpoint: str,
    clock: Callable[[], str] = ingest.utc_now, threshold: float = 0.1, order_by: str | None = None,
    name: str = "records",
) -> StreamingQuery:
    """Validate every micro-batch and load it as a run of its own; bad rows go to quarantine.

    A batch without a valid row ends as a failed run, and the stream goes on.
    """

    def load(batch_rows: DataFrame, batch: int) -> None:
        run_id = f"{name}-{batch}"
        columns = [c for c in batch_rows.columns if c not in ("source_file", SPLIT)]
        feed = _feed(batch_rows.fillna("", subset=columns), order_by)
        try:
            ingest.ingest_records(
                store, feed, dataset, run_id, run_id, clock(), threshold, clock=clock)
        except ingest.AllQuarantined:
            pass  # the audit row says so

    return (
        stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def first_tickets(stream: DataFrame, delay: str) -> DataFrame:
    """Drop repeated ticket ids on the stream itself, as long as the watermark remembers them.

    State is bounded by `delay`; an older repeat is caught by the `left_anti` on load.
    """
    created = C.utc_instant(C.to_moment(F.col("created_at")))
    return stream.withColumn("created_at", created).withWatermark(
        "created_at", delay).dropDuplicatesWithinWatermark(["ticket_id"])


def daily_ticket_volume(tickets: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tickets per creation day as a stream; a day is emitted once it can no longer change.

    Watermarks need instants, so `created_at` is one here (`columns.utc_instant`). Day windows
    start at midnight UTC, and the date is taken in UTC as well.
    """
    day = F.window("created_at", "1 day")
    return tickets.withWatermark("created_at", delay).groupBy(day).agg(
        F.count("*").alias("ticket_count"),
        F.count_if(F.col("priority") == "critical").alias("critical_count"),
    ).select(C.utc_day(F.col("window.start")).alias("date"), "ticket_count", "critical_count")
