"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary of the text digests (`DataFrame.freqItems`) names at most 1/support digests,
among them every digest held by more than `support` of the rows. Those are verified by an exact count and their
winners, at most 1/support short rows, are broadcast: the rows of large groups get their
winner map-side and are never shuffled. All other digests take the ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise, query, table, text_or_empty

#: Deleted before texts are compared: blank, tab, line feed, vertical tab, form feed, return.
WHITE_SPACE = " \t\n\x0b\x0c\r"

#: Share of all rows above which a digest counts as heavy; 1/SUPPORT rows are broadcast at most.
SUPPORT = 1 / 512


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; of equal texts the one with the most
    code points stays, then the one with the smallest id. NULL text counts as empty; empty texts
    are one group. A NULL id loses against any other. Of rows that repeat an id and a text exactly
    one is kept, and each counts in group_size. Other columns are ignored; an empty table
    gives no rows.
    """
    text = text_or_empty(text_col)
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.char_length(text).alias("n_code_points"),
            F.sha2(F.translate(text, WHITE_SPACE, "").cast("binary"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
        "exact-dedup",
    )
    order = F.struct(
        -F.col("n_code_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id")
    )
    winner = (F.min(order).alias("best"), F.count("*").alias("group_size"))

    frequent = rows.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256")
    )
    heavy = rows.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(*winner)
    heavy = materialise(heavy, "exact-dedup-heavy")
    marked = rows.join(F.broadcast(heavy), "text_sha256", "left")
    light = marked.filter("best is null").drop("best", "group_size")
    light = light.join(light.groupBy("text_sha256").agg(*winner), "text_sha256")
    return marked.filter("best is not null").unionByName(light).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "text_sha256",
    )


@query(
    "op4_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents),
    g AS (
      SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
      FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
