from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.functions import timeparts as T
from tidewatch.operators import dimensions


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("c"))).collect()]


def test_to_moment_accepts_the_listed_formats(spark):
    texts = ["2024-01-15", "2024-01-15 09:30:00", "2024-01-15T09:30:00", " 2024-01-15 ",
             "01/15/2024", "2024/01/15", "2024-01-15T09:30:00Z", "2024-01-15 09:30:00.250"]
    found = values(spark, texts, C.to_moment)
    day, moment = datetime(2024, 1, 15), datetime(2024, 1, 15, 9, 30)
    assert found == [day, moment, moment, day, day, day, moment,
                     datetime(2024, 1, 15, 9, 30, 0, 250000)]


def test_to_moment_gives_null_for_anything_else(spark):
    texts = ["bad-date", "", None, "31/31/2020", "2024-13-01", "2024", "12:30",
             "2024-01-15 09:30:00+05:00", "n/a"]
    assert values(spark, texts, C.to_moment) == [None] * len(texts)


def test_to_number(spark):
    texts = ["8.0", " -1 ", "1e3", ".5", "5.", "inf", "abc", "", None, "8f", "1d", "0x10", "nan"]
    expected = [8.0, -1.0, 1000.0, 0.5, 5.0, float("inf")] + [None] * 7
    assert values(spark, texts, C.to_number) == expected
    assert values(spark, ["abc", None, "nan", "2"], C.coerce_numeric) == [0.0, 0.0, 0.0, 2.0]


def test_truncate_int_cuts_towards_zero(spark):
    assert values(spark, ["2.7", "-2.7", "abc"], C.truncate_int) == [2, -2, 0]


def test_flags_are_read_as_words(spark):
    texts = ["True", "false", "1", "0", "YES", " no ", "maybe", None]
    assert values(spark, texts, C.parse_flag) == [True, False, True, False, True, False, False, False]


def test_clip_keeps_null(spark):
    found = values(spark, ["-3", "0.5", "9", None], lambda c: C.clip(C.to_number(c), -1.0, 1.0))
    assert found == [-1.0, 0.5, 1.0, None]


def test_parse_tags(spark):
    assert values(spark, ["a, b,,c ", "", None, ","], C.parse_tags) == [["a", "b", "c"], None, None, []]


def test_title_case_per_run_of_letters(spark):
    assert values(spark, ["SUPPORT_ops", "new york", "d0"], C.title_case) == [
        "Support_Ops", "New York", "D0"]


def test_rounded_ignores_the_last_bits(spark):
    below = spark.range(1).select(C.rounded(F.lit(97.24999999999999), 1)).first()[0]
    assert below == 97.3


def test_durations_do_not_depend_on_the_session_zone(spark):
    """02:30 does not exist on that day in New York; the feed is zone-free."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.createDataFrame(
            [("2024-03-10 01:30:00", "2024-03-10 03:30:00")], "a string, b string"
        ).select(C.hours_between(C.to_moment(F.col("a")), C.to_moment(F.col("b")))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row[0] == 2.0


def test_resolution_minutes_round_half_even(spark):
    rows = [("2024-01-01 00:00:00", f"2024-01-01 00:{m:02d}:30") for m in (0, 1, 2)]
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select(C.resolution_minutes(C.to_moment(F.col("a")), C.to_moment(F.col("b")))).collect()
    assert [r[0] for r in found] == [0, 2, 2]


def test_normalize_columns_styles(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`  Employee  ID ` int, `a-b` int, `C d` int")
    assert C.normalize_columns(df, "feed").columns == ["employee_id", "a-b", "c_d"]
    assert C.normalize_columns(df, "records").columns == ["employee__id", "a_b", "c_d"]
    assert C.normalize_columns(df, "rules").columns == ["employee__id", "a-b", "c_d"]


def test_require_columns_names_the_missing(spark):
    with pytest.raises(ValueError, match="Missing required columns.*date"):
        C.require_columns(spark.range(1), ["id", "date"])


def test_dim_date_matches_the_calendar(spark):
    days = spark.sql("select explode(sequence(date'1999-12-20', date'2005-01-10')) as d")
    for row in dimensions.build_dim_date(days, "d").collect():
        d: date = row["date"]
        assert row["week_of_year"] == int(d.strftime("%W"))
        assert row["day_of_week"] == d.weekday()
        assert row["day_name"] == d.strftime("%A") and row["month_name"] == d.strftime("%B")
        assert row["is_weekend"] == (d.weekday() >= 5) and row["is_holiday"] is False
        assert row["fiscal_year"] == (d.year if d.month >= 4 else d.year - 1)
        assert row["fiscal_quarter"] == ((d.month - 4) % 12) // 3 + 1
        assert row["date_id"] == int(d.strftime("%Y%m%d"))


def test_time_features_order(spark):
    assert T.FEATURES[:5] == ["day_of_week", "day_of_month", "month", "week_of_year", "t"]
