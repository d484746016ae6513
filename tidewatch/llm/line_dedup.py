"""Line dedup by site-relative frequency.

A line is boilerplate on a host when the host's documents that contain it are more than
`ratio` of the host's documents, and at least `least` of them. Lines are counted once for each
document, as a digest and a count of documents, combined before the shuffle, so neither a
hot host nor a hot line meets in one task. A host has at most (lines of a document) / ratio such lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialise, query, table

RATIO, LEAST = 0.02, 5
#: Hosts whose boilerplate is broadcast; with more it is joined by a shuffle.
BROADCAST_HOSTS = 20_000
_TRIM = " \t\r"


def _digest(line):
    return F.unhex(F.md5(F.btrim(line, F.lit(_TRIM))))


def _lines(text):
    return F.split(text, "\n", -1)


def boilerplate(
    docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, least: int = LEAST
) -> DataFrame:
    """host, documents, lines: the digests of the lines to drop, for each host that has some."""
    kept = F.filter(_lines(F.col(text_col)), lambda x: F.btrim(x, F.lit(_TRIM)) != "")
    lines = docs.select(
        F.col(host_col).alias("host"), F.explode(F.array_distinct(F.transform(kept, _digest))).alias("line")
    )
    sizes = docs.groupBy(F.col(host_col).alias("of")).agg(F.count("*").alias("documents"))
    common = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    common = common.join(sizes, common.host.eqNullSafe(sizes.of))
    return (
        common.filter(F.col("n") > ratio * F.col("documents"))
        .groupBy("host", "documents")
        .agg(F.collect_list("line").alias("lines"))
    )


def drop_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    least: int = LEAST,
) -> DataFrame:
    """`docs` with boilerplate lines dropped from the text, and columns n_lines, n_dropped.

    Lines end at line feeds and are compared without blanks, tabs and returns at their ends; blank
    lines are kept and never counted. A line that is repeated within a document counts once for it and goes
    every time. NULL text stays NULL with 0 lines; a text of boilerplate alone becomes empty and its
    row stays. NULL hosts are one host. Repeated rows count as documents of their own. An empty table gives no
    rows; columns named n_lines or n_dropped are replaced, other columns are passed through.
    """
    found = materialise(boilerplate(docs, host_col, text_col, ratio, least), "boilerplate")
    few = found.count() <= BROADCAST_HOSTS
    found = found.select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    joined = docs.select(*columns).join(
        F.broadcast(found) if few else found,
        F.col(host_col).eqNullSafe(F.col("__host")),
        "left",
    )
    lines = _lines(F.col(text_col))
    good = F.filter(lines, lambda x: ~F.array_contains(F.col("__lines"), _digest(x)))
    untouched = F.col("__lines").isNull() | F.col(text_col).isNull()
    total = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    marked = joined.withColumn("__good", F.when(~untouched, good)).withColumn("n_lines", total)
    marked = marked.withColumn(
        "n_dropped", F.when(untouched, 0).otherwise(F.col("n_lines") - F.size("__good"))
    )
    cleaned = F.when(untouched, F.col(text_col)).otherwise(F.array_join("__good", "\n"))
    return marked.withColumn(text_col, cleaned).drop("__host", "__lines", "__good")


@query(
    "op6_line_dedup",
    f"""
    WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
    l AS (
      SELECT DISTINCT doc_id, source, trim(line, ' ' || chr(9) || chr(13)) AS line
      FROM (SELECT doc_id, source, unnest(lines) AS line FROM d)),
    s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    b AS (
      SELECT l.source, list(DISTINCT line) AS bad
      FROM (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY source, line) l
      JOIN s USING (source)
      WHERE l.n >= {LEAST} AND l.n > {RATIO} * s.n
      GROUP BY l.source),
    k AS (
      SELECT doc_id, d.source, text, lines,
             [x FOR x IN lines IF NOT list_contains(
               coalesce(bad, []::VARCHAR[]), trim(x, ' ' || chr(9) || chr(13)))] AS good
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(good, chr(10)) END AS text,
           coalesce(len(lines), 0)::INT AS n_lines,
           (coalesce(len(lines), 0) - coalesce(len(good), 0))::INT AS n_dropped
    FROM k
    """,
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "text", "n_lines", "n_dropped"
    )
