"""Column expressions that the cleaners and validators are built from.

All of them are plain Catalyst expressions: a bad value becomes NULL (or the given
default) instead of failing the job, also under ANSI mode.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER_CHARACTERS = r"^[\s\d.eE+-]+$"
INFINITIES = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]
ISO_MOMENT = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?Z?)?$"

_HEADER_STYLES = {
    "feed": lambda name: re.sub(r"\s+", "_", name.strip().lower()),
    "records": lambda name: name.strip().lower().replace(" ", "_").replace("-", "_"),
    "rules": lambda name: name.strip().lower().replace(" ", "_"),
}


# --- headers -----------------------------------------------------------------
WHITE_SPACE = " \t\n\x0b\x0c\r"


def trimmed(c: Column) -> Column:
    """Text without white space at its ends; `trim` alone takes blanks only."""
    return F.btrim(c.cast("string"), F.lit(WHITE_SPACE))


def normalize_columns(df: DataFrame, style: str = "feed") -> DataFrame:
    """Lower-case header names with underscores; `style` picks what becomes one."""
    return df.toDF(*[_HEADER_STYLES[style](c) for c in df.columns])


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of `names` that the frame has, else NULL."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None).cast("string"))


def with_default(df: DataFrame, name: str, value) -> DataFrame:
    """Fill NULLs of a column with a constant; add the column where it is absent."""
    filled = F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
    return df.withColumn(name, filled)


# --- numbers -----------------------------------------------------------------
def to_number(c: Column) -> Column:
    """Text to double, NULL for anything that is not a number (NaN included).

    The characters are checked first: the cast alone would also take Java forms such as
    "8f", and costs an exception per value that it cannot read.
    """
    text = c.cast("string")
    value = text.try_cast("double")
    return F.when(text.rlike(NUMBER_CHARACTERS), value).when(
        F.lower(F.trim(text)).isin(INFINITIES), value)


def to_float(c: Column) -> Column:
    """As `to_number`, but "nan" is read as the float NaN."""
    text = F.lower(F.trim(c.cast("string")))
    return F.coalesce(to_number(c), F.when(text.isin("nan", "+nan", "-nan"), F.lit(float("nan"))))


def coerce_numeric(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(to_number(c), F.lit(default))


def truncate_int(c: Column) -> Column:
    """Text or number to a whole number, cut towards zero; 0 where it is no number."""
    return coerce_numeric(c).cast("int")


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value. NULL stays NULL: greatest and least would skip it."""
    bounded = c
    if lo is not None:
        bounded = F.greatest(bounded, F.lit(lo))
    if hi is not None:
        bounded = F.least(bounded, F.lit(hi))
    return F.when(c.isNotNull(), bounded)


def clamp_negative(c: Column) -> Column:
    return clip(c, lo=0.0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero denominator instead of an ANSI error."""
    return numerator / F.when(denominator != 0, denominator)


def rounded(c: Column, places: int) -> Column:
    """Round an aggregate half up, blind to the last bits of the double.

    The order in which a cluster adds doubles changes those bits, and they must not decide
    which way a tie such as 97.25 goes.
    """
    return F.round(F.round(c, 9), places)


# --- dates and times ---------------------------------------------------------
def to_moment(c: Column) -> Column:
    """Text to a zone-free timestamp; NULL where no accepted format fits.

    Accepted: yyyy-MM-dd, the same with a time after a blank or T, MM/dd/yyyy, yyyy/MM/dd.
    """
    given = F.trim(c.cast("string"))
    us = F.regexp_replace(given, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2")
    text = F.when(given.contains("/"), F.replace(us, F.lit("/"), F.lit("-"))).otherwise(given)
    return F.when(text.rlike(ISO_MOMENT), text.try_cast("timestamp_ntz"))


def to_day(c: Column) -> Column:
    return to_moment(c).cast("date")


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from start to end, without a detour over the session time zone."""
    gap = end - start

    def part(name: str) -> Column:
        return F.extract(F.lit(name), gap)

    return (
        part("DAY").cast("long") * F.lit(86_400_000_000)
        + part("HOUR").cast("long") * F.lit(3_600_000_000)
        + part("MINUTE").cast("long") * F.lit(60_000_000)
        + (part("SECOND") * 1_000_000).cast("long")
    )


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(3_600_000_000.0)


def utc_instant(moment: Column) -> Column:
    """A zone-free timestamp as the instant it names in UTC, whatever the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(micros_between(epoch, moment))


def utc_day(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / 86_400_000_000).cast("int"))


# --- text and flags ----------------------------------------------------------
def standardize_enum(c: Column, allowed: Sequence[str], default: str) -> Column:
    """Trimmed lower case; anything outside the list, NULL too, becomes the default."""
    value = F.lower(F.trim(c))
    return F.when(value.isin(list(allowed)), value).otherwise(F.lit(default))


def map_values(c: Column, table: Mapping[str, object]) -> Column:
    """Look a value up in a small fixed table; NULL where it is not in there."""
    (first, value), *rest = table.items()
    chain = F.when(c == first, F.lit(value))
    for key, value in rest:
        chain = chain.when(c == key, F.lit(value))
    return chain


def parse_flag(c: Column, default: bool = False) -> Column:
    """true/false, yes/no and 1/0 in any case; all else is the default."""
    text = F.lower(F.trim(c.cast("string")))
    return (
        F.when(text.isin("true", "yes", "1"), F.lit(True))
        .when(text.isin("false", "no", "0"), F.lit(False))
        .otherwise(F.lit(default))
    )


def parse_tags(c: Column) -> Column:
    """Comma list to an array without empty entries; NULL for a blank list."""
    tags = F.filter(F.transform(F.split(c, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(c != "", tags)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def na_to_null(c: Column, tokens: Sequence[str]) -> Column:
    return F.when(~c.isin(list(tokens)), c)


def title_case(c: Column) -> Column:
    """Capital at the start of every run of letters, lower case for the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def fixed(c: Column, places: int) -> Column:
    """Text with a fixed number of places, rounded half up first."""
    return F.format_string(f"%.{places}f", F.round(c, places))


def raw_json(df: DataFrame, skip: Sequence[str] = ()) -> Column:
    """The row as JSON text, NULL fields included."""
    kept = [F.col(c) for c in df.columns if c not in skip]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})


# --- measures of the feeds ---------------------------------------------------
def utilization_rate(actual: Column, scheduled: Column) -> Column:
    """Worked share of the schedule within [0, 2]; 0 without a schedule."""
    return F.when(scheduled > 0, clip(ratio(actual, scheduled), 0.0, 2.0)).otherwise(F.lit(0.0))


def utilization_pct(actual: Column, scheduled: Column) -> Column:
    """Worked share in percent, one place and unbounded; NULL without a schedule."""
    return F.when(scheduled > 0, F.round(ratio(actual, scheduled) * 100, 1))


def overtime(actual: Column, scheduled: Column) -> Column:
    return F.greatest(actual - scheduled, F.lit(0.0))


def resolution_minutes(created: Column, resolved: Column) -> Column:
    """Whole minutes, halves to the even neighbour."""
    return F.bround(micros_between(created, resolved) / F.lit(60_000_000.0), 0).cast("long")


def breached(taken: Column, target: Column) -> Column:
    return F.coalesce(taken > target, F.lit(False))


def open_overdue(status: Column, created: Column, target_hours: Column, as_of: Column) -> Column:
    """Still open and older than the target at `as_of`."""
    late = hours_between(created, as_of) > target_hours
    return F.coalesce(status.isin("open", "in_progress") & late, F.lit(False))
