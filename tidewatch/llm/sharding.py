"""Shards of near equal bytes: minimax contiguous partition of atomic groups.

Rows with equal texts are one atomic group. Groups have a fixed order: the few coarse ones first,
largest first, then the fine ones by digest, so that shards are random mixtures and no cut falls
on a large group unless it must. The smallest capacity for which a greedy cut of that order
needs no more than the wanted number of shards is found by binary search on the driver, over a
summary of bounded size:

* coarse groups one by one (each over 1/COARSE of a shard, so at most shards * COARSE of them);
* fine groups summed by the first digits of their digest.

A cell of several groups gives two answers: with cells cut nowhere (too few cuts are possible, an
upper bound) and cut anywhere (a lower bound). Both bounds fence each cut into a few cells, those are split
by two more digits in one aggregation, and so on until every fenced cell is a single group:
then both answers agree and are exact. Each level reads a narrow table and returns few rows.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise, query, shuffle_width, table, text_or_empty

SHARDS = 24
#: A group over 1/COARSE of the mean shard is placed by size, one by one.
COARSE = 256
#: Hexadecimal digits of the digest that name a cell at first, and those added at each level.
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Rows that get their slot in one sort.
ROWS_PER_SLOT_BUCKET = 200_000


class Cells:
    """Sizes in order. A cell that is not atomic can be cut inside, at places yet unknown."""

    def __init__(self, cells):
        self.cells = sorted(cells)  # (coarse first, -size or 0, digest prefix, size, atomic)
        self.ends = [0, *accumulate(c[3] for c in self.cells)]
        self.total = self.ends[-1]

    def cuts(self, capacity: int, shards: int, anywhere: bool) -> list[int] | None:
        """Greedy end positions of the shards; None if more than `shards` would be needed."""
        at, found = 0, []
        for _ in range(shards):
            reach = at + capacity
            if reach >= self.total:
                return [*found, self.total]
            cell = bisect_right(self.ends, reach) - 1
            if not (anywhere and not self.cells[cell][4]):
                reach = self.ends[cell]
            if reach <= at:
                return None
            at = reach
            found.append(at)
        return None

    def least_capacity(self, shards: int, anywhere: bool) -> int:
        low, high = max(1, -(-self.total // shards)), max(1, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, anywhere) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def fenced(self, shards: int) -> set[int]:
        """Cells in which a cut can lie and that are not single groups."""
        at_least, at_most = self.least_capacity(shards, True), self.least_capacity(shards, False)
        low, at = [], 0
        for _ in range(shards):  # whole cells at the lower bound: never past the exact greedy cut
            at = self.ends[bisect_right(self.ends, min(at + at_least, self.total)) - 1]
            low.append(at)
        high = self.cuts(at_most, shards, True)
        high += [self.total] * (shards - len(high))
        return {
            i
            for a, b in zip(low, high)
            for i in range(bisect_right(self.ends, a) - 1, min(bisect_right(self.ends, b), len(self.cells)))
            if not self.cells[i][4]
        }


def _cells(groups: DataFrame, digits: int, coarse_from: int) -> DataFrame:
    fine = F.col("size") < coarse_from
    prefix = F.when(fine, F.substring("digest", 1, digits)).otherwise(F.col("digest"))
    return (
        groups.groupBy(
            fine.cast("int").alias("fine"),
            F.when(fine, F.lit(0).cast("long")).otherwise(-F.col("size")).alias("rank"),
            prefix.alias("prefix"),
        )
        .agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("digest").alias("digest"))
    )


def _as_cell(row) -> tuple:
    atomic = row["n"] == 1
    return (row["fine"], row["rank"], row["digest"] if atomic else row["prefix"], row["size"], atomic)


def cut_points(groups: DataFrame, total: int, shards: int, coarse_from: int) -> list[tuple]:
    """Order keys (fine, rank, digest) of the first group of each shard after the first."""
    alone = []  # a group over a fair share of what is left has a shard for itself
    for row in (
        groups.filter(F.col("size") * shards > total).orderBy(F.desc("size"), "digest").limit(shards).collect()
    ):
        if len(alone) < shards - 1 and row["size"] * (shards - len(alone)) > total:
            alone.append((0, -row["size"], row["digest"]))
            total -= row["size"]
    wanted = shards - len(alone)
    digits = FIRST_DIGITS
    rows = _cells(groups, digits, coarse_from).collect()
    cells = Cells([c for c in map(_as_cell, rows) if c[:3] not in set(alone)])
    while fenced := cells.fenced(wanted):
        prefixes = [cells.cells[i][2] for i in sorted(fenced)]
        inside = F.lit(False)
        for n in sorted({len(p) for p in prefixes}):
            inside |= F.substring("digest", 1, n).isin([p for p in prefixes if len(p) == n])
        digits += MORE_DIGITS
        finer = _cells(groups.filter((F.col("size") < coarse_from) & inside), digits, coarse_from)
        kept = [c for i, c in enumerate(cells.cells) if i not in fenced]
        cells = Cells(kept + [_as_cell(row) for row in finer.collect()])
    ends = cells.cuts(cells.least_capacity(wanted, False), wanted, False)
    starts = [cells.cells[bisect_right(cells.ends, e) - 1][:3] for e in ends if e < cells.total]
    first = [cells.cells[0][:3]] if alone and cells.cells else []
    return sorted([*alone[1:], *first, *starts])


def minimax_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    coarse: int = COARSE,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The size of a row is its UTF-8 bytes plus 8; NULL text has none and counts as an empty text.
    Equal texts share a shard. The largest shard is as small as the fixed group order allows; a
    group over the fair share of what remains has a shard for itself, and the rest is cut among
    the others. Equal digests cannot tie; repeated rows keep rows of their own and get slots of their own. An
    empty table gives no rows. Other columns are ignored. Slots count each shard's rows from 0.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col).cast("binary")
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("digest"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
        "shard-rows",
    )
    groups = materialise(rows.groupBy("digest").agg(F.sum("size").alias("size")), "shard-groups")
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    coarse_from = max(1, total // (shards * coarse))
    points = cut_points(groups, total, shards, coarse_from) if n_rows else []

    large = groups.filter(F.col("size") >= coarse_from).select("digest", F.col("size").alias("group"))
    ranked = rows.join(F.broadcast(large), "digest", "left").withColumn(
        "key",
        F.struct(
            F.when(F.col("group").isNull(), 1).otherwise(0).alias("fine"),
            F.coalesce(-F.col("group"), F.lit(0).cast("long")).alias("rank"),
            F.col("digest").alias("digest"),
        ),
    )
    shard = F.lit(0)
    for fine, rank, digest in points:
        start = F.struct(
            F.lit(fine).alias("fine"), F.lit(rank).cast("long").alias("rank"), F.lit(digest).alias("digest")
        )
        shard = shard + (F.col("key") >= start).cast("int")
    placed = ranked.select("doc_id", "size", "text_crc32", "row_id", shard.alias("shard"))
    return _with_slots(placed, n_rows, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _with_slots(placed: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """Gapless slots without one sort per shard: number within buckets, add the buckets before."""
    spark = placed.sparkSession
    buckets = max(4 * shuffle_width(spark), n_rows // ROWS_PER_SLOT_BUCKET) // shards + 1
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "row_id")
    return (
        placed.withColumn("number", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "bucket"])
        .withColumn("slot", F.col("offset") + F.col("number"))
    )


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"))
