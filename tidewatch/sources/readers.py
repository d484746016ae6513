"""Readers of feed files: CSV and JSON, everything as text, in feed order."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.operators import cleaning
from tidewatch.operators.dedup import FILE_ROW, ROW_INDEX
from tidewatch.session import written
from tidewatch.sources.landing import UNREADABLE, Landed, land, placed

SIGNAL_FIELDS = [
    "signal_date", "date", "source", "title", "category", "subcategory", "region", "industry",
    "value", "value_label", "change_pct", "notes", "summary", "sentiment_score",
    "relevance_score", "url", "tags",
]


def _is_broken(text: Column, n_fields: int) -> Column:
    """More fields than the header, or a quoted field that is never closed.

    A record with fewer fields is a good one, whose last fields are NULL; a quote inside a bare field is text.
    """
    bare = F.regexp_replace(text, '"[^"]*"', "")
    fields = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    torn = (fields != n_fields) & F.contains(bare, F.lit('"'))
    return (fields > n_fields) | torn | bare.rlike('(^|,)"')


def _land_records(spark: SparkSession, path: str, names: list[str], options: dict) -> Landed:
    """Records that may go over several lines: the CSV reader takes each file as a whole."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, UNREADABLE]])
    reader = spark.read.options(**options).option("enforceSchema", False).schema(schema)
    records = reader.option("columnNameOfCorruptRecord", UNREADABLE).csv(path)
    text = F.col(UNREADABLE)
    broken = F.when(_is_broken(text, len(names)), text).alias(UNREADABLE)
    return land(placed(records, *[f"`{n}`" for n in names], broken), "csv-feed")


def _land_lines(spark: SparkSession, path: str, names: list[str], options: dict) -> Landed:
    """Records of one line: lines are landed as they are and parsed when they are read."""
    lines = spark.read.text(path).filter(F.btrim("value") != "")
    landed = land(placed(lines, F.col("value").alias("_line")), "csv-feed", header="_line")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    fields = F.from_csv("_line", schema, {k: options[k] for k in ("quote", "escape")})
    broken = F.when(_is_broken(F.col("_line"), len(names)), F.col("_line"))
    table = landed.table.select("*", fields.alias("_fields"), broken.alias(UNREADABLE)).select(
        "_fields.*", UNREADABLE, "source_file", FILE_ROW, ROW_INDEX)
    malformed = landed.table.filter(_is_broken(F.col("_line"), len(names)))
    bad = malformed.groupBy("_path").agg(F.count("*").alias("malformed"))
    files = landed.files.drop("malformed").join(bad, F.col("path") == F.col("_path"), "left")
    files = files.drop("_path").fillna(0, subset=["malformed"])
    return Landed(table, written(files, "csv-files"))


def land_csv(
    spark: SparkSession, path: str, keep_blank: bool = False, multi_line: bool = True
) -> Landed:
    """All-string CSV with a header, landed in order of path and place in the file.

    By default blanks and the usual missing-value tokens become NULL; `keep_blank` keeps
    every value as it stands, with '' for a blank. Headers must agree between the files of
    a folder; blank lines are no records. A record with more fields than the header, or with a quoted field that
    is never closed, is malformed; one with fewer fields is padded. `multi_line` allows line breaks inside
    quotes, at one task per file; set it to False so that Spark can split the files, and both
    halves of a quoted line break become malformed records.
    """
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line}
    names = spark.read.options(**options).csv(path).columns
    landed = (_land_records if multi_line else _land_lines)(spark, path, names, options)
    if keep_blank:
        table = landed.table.fillna("", subset=names)
    else:
        table = landed.table.withColumns({n: C.na_to_null(F.col(f"`{n}`"), V.NA_TOKENS) for n in names})
    return Landed(table, landed.files)


def land_json(
    spark: SparkSession, path: str, fields: list[str] = SIGNAL_FIELDS, multi_line: bool = True
) -> Landed:
    """Records of JSON documents: an array, {"signals": […]}, {"data": […]} or one object.

    With `multi_line` a file is one document; without it every line is one, and files are
    split. Values are read as text; a record without `signal_date` takes its `date`. Fields outside `fields`
    are not read. A document that is no JSON, or whose lists are no lists, is one malformed record.
    """
    record = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    several = T.ArrayType(record)
    schema = T.StructType([*record.fields, T.StructField("signals", several),
                           T.StructField("data", several), T.StructField(UNREADABLE, T.StringType())])
    reader = spark.read.option("multiLine", multi_line).schema(schema)
    documents = placed(reader.option("columnNameOfCorruptRecord", UNREADABLE).json(path), *schema.names)
    alone = F.array(F.struct(*fields))
    found = F.when(F.col(UNREADABLE).isNotNull(), F.array(F.lit(None).cast(record))).otherwise(
        F.coalesce("signals", "data", alone))
    records = documents.select(
        F.explode(found).alias("_record"), UNREADABLE, "_path", "source_file", "_block"
    ).select("_record.*", UNREADABLE, "_path", "source_file", "_block")
    if "signal_date" in fields and "date" in fields:
        records = records.withColumn("signal_date", F.coalesce("signal_date", "date")).drop("date")
    return land(records, "json-feed")


def read_csv_feed(
    spark: SparkSession, path: str, keep_blank: bool = False, multi_line: bool = True
) -> DataFrame:
    """The readable records of `land_csv`, with source_file, file_row and row_index."""
    return land_csv(spark, path, keep_blank, multi_line).rows


def read_json_feed(
    spark: SparkSession, path: str, fields: list[str] = SIGNAL_FIELDS, multi_line: bool = True
) -> DataFrame:
    """The readable records of `land_json`, with source_file, file_row and row_index."""
    return land_json(spark, path, fields, multi_line).rows


def check_route(path: str, source_type: str) -> str:
    """The cleaner a file goes to. JSON always holds market signals."""
    if source_type not in V.FEED_TYPES:
        raise ValueError(f"source_type must be one of {V.FEED_TYPES}, got {source_type!r}")
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in V.FEED_EXTENSIONS:
        raise ValueError(f"File type {suffix!r} not allowed, expected one of {V.FEED_EXTENSIONS}")
    return "market" if suffix == ".json" else source_type


def clean_feed(feed: DataFrame, source_type: str, as_of: str) -> cleaning.Cleaned:
    if source_type == "workforce":
        return cleaning.clean_workforce(feed)
    if source_type == "tickets":
        return cleaning.clean_tickets(feed, as_of)
    if source_type == "market":
        return cleaning.clean_market_signals(feed)
    raise ValueError(f"Unknown source_type: {source_type}. Expected: {V.FEED_TYPES}")


def land_feed(spark: SparkSession, path: str, source_type: str, multi_line: bool = True) -> tuple[Landed, str]:
    """Check the route and land the file or folder; the records and the cleaner they go to."""
    route = check_route(path, source_type)
    is_json = path.lower().endswith(".json")
    return (land_json if is_json else land_csv)(spark, path, multi_line=multi_line), route


def read_feed(
    spark: SparkSession, path: str, source_type: str, as_of: str, multi_line: bool = True
) -> cleaning.Cleaned:
    """Check the route, read the file and clean it."""
    landed, route = land_feed(spark, path, source_type, multi_line)
    return clean_feed(landed.rows, route, as_of)
