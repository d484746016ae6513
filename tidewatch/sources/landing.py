"""Landing of feed files: every record is read once, numbered in feed order, and kept.

Spark deals the splits of many files to tasks by size, so an id that grows along the tasks says nothing about
the order of the files. A record's place is (path of the file, first byte of the split, place in the
split). The records are written once, the records of each split are counted, and prefix sums over the splits turn
places into numbers. No record is sorted or moved for it, and whoever reads the table later, or again after a
lost executor, finds the same numbers.

Records that cannot be read as the header or the document form says stay in the table with their
original text; `Landed.malformed` has them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.dedup import FILE_ROW, ROW_INDEX
from tidewatch.session import written

#: Text of a record that could not be read, NULL for the others.
UNREADABLE = "_unreadable"
#: Splits whose offsets (fixed width, some 80 bytes) are broadcast; with more they are joined by a shuffle.
BROADCAST_SPLITS = 50_000


@dataclass(frozen=True)
class Landed:
    """`table`: the columns of the feed, source_file, file_row (from 1 in each file, unreadable records
    included), row_index (from 0 over all files in order of their paths) and the unreadable text.

    `files`: path, source_file, records and malformed records of each file that has any line (in the
    multi-line forms, any record).
    """

    table: DataFrame
    files: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.table.filter(F.col(UNREADABLE).isNull()).drop(UNREADABLE)

    @property
    def malformed(self) -> DataFrame:
        """row_index, source_file, file_row, raw_data: the original text of unreadable records."""
        bad = self.table.filter(F.col(UNREADABLE).isNotNull())
        return bad.select(ROW_INDEX, "source_file", FILE_ROW, F.col(UNREADABLE).alias("raw_data"))

    def counts(self) -> tuple[int, int]:
        """Records and malformed records of the feed, from the counts of the files."""
        total = self.files.agg(F.sum("records"), F.sum("malformed")).first()
        return total[0] or 0, total[1] or 0


def placed(records: DataFrame, *columns: str | Column) -> DataFrame:
    """`columns` of a file scan with the place of each record: file, split, and an id that grows in the split."""
    return records.select(
        *columns,
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def _before(window) -> Column:
    return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def land(records: DataFrame, name: str, header: str | None = None) -> Landed:
    """Write `records` (from `placed`) and number them.

    With `header`, the first record of each file is no record but names the columns: it is left out, and
    all files must agree on the text of that column. Otherwise UNREADABLE is a column of `records`.
    """
    split = F.md5(F.concat_ws(":", "_path", F.col("_block").cast("string")))
    records = records.withColumns({"_split": split, "_at": F.monotonically_increasing_id()})
    table = written(records, name)
    bad = F.lit(0) if header else F.count(UNREADABLE)
    first = F.min_by(header, "_at") if header else F.lit(None).cast("string")
    splits = table.groupBy("_split", "_path", "source_file", "_block").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first"), bad.alias("_bad"), first.alias("_names"))
    splits = written(splits, f"{name}-splits")  # one row for each split
    skipped = 1 if header else 0
    files = splits.groupBy(F.col("_path").alias("path"), "source_file").agg(
        (F.sum("_n") - skipped).alias("records"), F.sum("_bad").alias("malformed"),
        F.min_by("_names", "_block").alias("_names"))
    if header:
        found = [r[0] for r in files.select("_names").distinct().limit(2).collect()]
        if len(found) > 1:
            raise ValueError(f"headers differ between the files: {found}")
    starts = files.select("path", F.col("records").alias("_n")).withColumn(
        "_files_before", _before(Window.orderBy("path"))).drop("_n")
    in_file = splits.withColumn("_before", _before(Window.partitionBy("_path").orderBy("_block")))
    offsets = in_file.join(starts, F.col("_path") == F.col("path")).select(
        "_split", "_first", "_before", "_files_before")
    few = splits.count() <= BROADCAST_SPLITS
    joined = table.join(F.broadcast(offsets) if few else offsets, "_split")
    place = F.col("_before") + F.col("_at") - F.col("_first") - skipped
    numbered = joined.filter(place >= 0) if header else joined
    numbered = numbered.withColumns({FILE_ROW: place + 1, ROW_INDEX: F.col("_files_before") + place})
    own = ["_split", "_block", "_at", "_first", "_before", "_files_before"]
    return Landed(numbered.drop(*own, *([] if header else ["_path"])), files.drop("_names"))
