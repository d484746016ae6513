"""Whole-feed cleaners: all-string feeds in, typed rows and tagged errors out.

Every cleaner needs a column that gives the order of the rows in the feed, because
"first" and "last" duplicates are defined by it (`row_index`, set by the readers).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.operators.dedup import POINTER, dedup


@dataclass(frozen=True)
class Cleaned:
    """`tagged` holds every row that survived dedup, with `error_code` and `raw_data` NULL for good ones.

    `clean` and `errors` are filters over it, so persisting `tagged` serves both.
    """

    tagged: DataFrame

    @property
    def clean(self) -> DataFrame:
        return self.tagged.filter(F.col("error_code").isNull()).drop("error_code", "raw_data")

    @property
    def errors(self) -> DataFrame:
        """error_code, raw_data, and where the row came from, as far as the feed says."""
        pointer = [c for c in POINTER if c in self.tagged.columns]
        return self.tagged.filter(F.col("error_code").isNotNull()).select(
            *pointer, "error_code", "raw_data"
        )


def _with_raw(df: DataFrame, bad: Column, *parsed: str) -> DataFrame:
    """Add the rows that are `bad` as JSON; `parsed` helper columns are not part of it."""
    return df.withColumn("raw_data", F.when(bad, C.raw_json(df, skip=(*POINTER, *parsed))))


def _trimmed(df: DataFrame, names: Sequence[str], change=lambda c: c) -> DataFrame:
    """Trim the named columns that exist, then apply `change`."""
    return df.withColumns({n: change(C.trimmed(F.col(n))) for n in names if n in df.columns})


def _as(df: DataFrame, name: str, convert) -> Column:
    """convert(column), or convert(NULL) where the feed has no such column."""
    return convert(C.first_present(df, name))


# --- feeds of the file upload --------------------------------------------------
def clean_workforce(df: DataFrame) -> Cleaned:
    """Daily hours per employee.

    First row per (employee_id, date text) wins; then dates and numbers are parsed.
    Errors: invalid_date, hours_out_of_range (scheduled outside 0..24).
    """
    df = C.require_columns(C.normalize_columns(df), V.WORKFORCE_REQUIRED)
    given = set(df.columns)
    # Parsed below the dedup, a date is computed once; above it, every filter on the date
    # would carry a copy of the parsing.
    df = df.withColumn("_date", C.to_day(F.col("date")))
    df = dedup(df, ["employee_id", "date"]).withColumn("_scheduled", C.coerce_numeric(F.col("scheduled_hours")))
    scheduled = F.col("_scheduled")
    error = F.when(F.col("_date").isNull(), "invalid_date").when(
        (scheduled < 0) | (scheduled > 24), "hours_out_of_range")
    df = _with_raw(df, error.isNotNull(), "_date", "_scheduled").withColumn("error_code", error)

    numbers = {c: C.coerce_numeric(F.col(c)) for c in V.WORKFORCE_NUMERIC if c in given}
    df = df.withColumns({**numbers, "scheduled_hours": scheduled})
    df = df.drop("date", "_scheduled").withColumnRenamed("_date", "date")
    scheduled = F.col("scheduled_hours")
    df = df.withColumn("actual_hours", C.clamp_negative(F.col("actual_hours")))
    actual = F.col("actual_hours")
    df = df.withColumn("utilization_rate", C.utilization_rate(actual, scheduled))
    if "overtime_hours" not in given:
        df = df.withColumn("overtime_hours", C.overtime(actual, scheduled))
    absent = C.parse_flag(F.col("absent")) if "absent" in given else actual == 0
    df = df.withColumn("absent", absent)
    df = C.with_default(df, "absence_reason", "")
    return Cleaned(C.with_default(df, "department_code", V.DEFAULT_DEPARTMENT))


def clean_tickets(df: DataFrame, as_of: str) -> Cleaned:
    """Support tickets. First row per ticket_id wins; `as_of` decides what is overdue.

    Error: invalid_created_at.
    """
    df = C.require_columns(C.normalize_columns(df), V.TICKET_REQUIRED)
    now = F.lit(as_of).cast("timestamp_ntz")
    times = {"_created": C.to_moment(F.col("created_at")),
             "_resolved": _as(df, "resolved_at", C.to_moment)}
    df = dedup(df.withColumns(times), ["ticket_id"])  # parsed once, see above
    df = _with_raw(df, F.col("_created").isNull(), *times)

    df = df.drop("created_at", "resolved_at").withColumnsRenamed(
        {"_created": "created_at", "_resolved": "resolved_at"})
    df = df.withColumns({
        "priority": C.standardize_enum(F.col("priority"), V.PRIORITIES, "medium"),
        "status": C.standardize_enum(F.col("status"), V.STATUSES, "open"),
        "sentiment_score": _as(df, "sentiment_score", C.coerce_numeric),
        "escalated": _as(df, "escalated", C.parse_flag),
    })
    created, resolved = F.col("created_at"), F.col("resolved_at")
    df = df.withColumns({
        "error_code": F.when(created.isNull(), "invalid_created_at"),
        "sla_target_hours": C.map_values(F.col("priority"), V.SLA_HOURS).cast("double"),
        "actual_resolution_hours": C.hours_between(created, resolved),
    })
    target = F.col("sla_target_hours")
    df = df.withColumn(
        "sla_breached",
        C.breached(F.col("actual_resolution_hours"), target)
        | C.open_overdue(F.col("status"), created, target, now),
    )
    df = C.with_default(df, "channel", "portal")
    return Cleaned(C.with_default(df, "department_code", V.DEFAULT_DEPARTMENT))


def clean_market_signals(df: DataFrame) -> Cleaned:
    """Market signals; no dedup. Error: invalid_signal_date."""
    df = C.normalize_columns(df)
    df = df.withColumn("_day", C.to_day(C.first_present(df, "signal_date", "date")))
    df = _with_raw(df, F.col("_day").isNull(), "_day").withColumns({
        "signal_date": F.col("_day"),
        "value": _as(df, "value", C.coerce_numeric),
        "change_pct": _as(df, "change_pct", C.coerce_numeric),
    }).drop("_day")
    df = C.with_default(C.with_default(df, "source", "unknown"), "category", "general")
    return Cleaned(
        df.withColumn("error_code", F.when(F.col("signal_date").isNull(), "invalid_signal_date"))
    )


# --- feeds of the validated record load ----------------------------------------
def clean_employees(df: DataFrame) -> DataFrame:
    """Employee master records; the last row per employee_code wins."""
    df = C.normalize_columns(df, "records")
    df = _trimmed(df, ["full_name", "role", "department_code"])
    df = _trimmed(df, ["email"], F.lower)
    df = _trimmed(df, ["employee_code"], F.upper)
    df = C.with_default(df, "status", "active")
    df = df.withColumns({
        "hire_date": C.to_day(F.col("hire_date")),
        "status": F.lower("status"),
        "seniority_level": _as(df, "seniority_level", F.lower),
        "hourly_rate": _as(df, "hourly_rate", C.to_number),
    })
    return dedup(df, ["employee_code"], keep="last")


def clean_operations_records(df: DataFrame) -> DataFrame:
    """Validated daily hours; the last row per (employee_code, date) wins."""
    df = C.normalize_columns(df, "records")
    hours = ["scheduled_hours", "actual_hours", "overtime_hours"]
    df = _trimmed(df, ["employee_code"], F.upper).withColumns({
        "date": C.to_day(F.col("date")),
        "tasks_completed": _as(df, "tasks_completed", C.truncate_int),
        "is_absent": _as(df, "is_absent", C.parse_flag),
        **{h: _as(df, h, lambda c: C.clip(C.coerce_numeric(c), lo=0.0)) for h in hours},
    })
    actual, scheduled = F.col("actual_hours"), F.col("scheduled_hours")
    df = df.withColumns({
        "is_absent": F.col("is_absent") | (actual == 0),
        "utilization_pct": C.utilization_pct(actual, scheduled),
    })
    return dedup(df, ["employee_code", "date"], keep="last")


def clean_ticket_records(df: DataFrame) -> DataFrame:
    """Validated tickets; the last row per ticket_number wins."""
    df = C.normalize_columns(df, "records")
    df = _trimmed(df, ["ticket_number"], F.upper)
    df = _trimmed(df, ["category", "priority", "status"], F.lower)
    df = df.withColumns({
        "created_at": C.to_moment(F.col("created_at")),
        "resolved_at": _as(df, "resolved_at", C.to_moment),
    })
    df = df.withColumns({
        "resolution_minutes": C.resolution_minutes(F.col("created_at"), F.col("resolved_at")),
        "sla_target_minutes": C.map_values(F.col("priority"), V.SLA_MINUTES),
    })
    df = df.withColumn(
        "sla_breached", C.breached(F.col("resolution_minutes"), F.col("sla_target_minutes"))
    )
    return dedup(df, ["ticket_number"], keep="last")


def clean_signal_records(df: DataFrame) -> DataFrame:
    """Validated market signals; scores bounded, tags split; no dedup."""
    df = C.normalize_columns(df, "records")
    return _trimmed(_trimmed(df, ["category"], F.lower), ["source"]).withColumns({
        "signal_date": C.to_day(F.col("signal_date")),
        "sentiment_score": _as(df, "sentiment_score", lambda c: C.clip(C.to_number(c), -1.0, 1.0)),
        "relevance_score": _as(df, "relevance_score", lambda c: C.clip(C.to_number(c), 0.0, 1.0)),
        "tags": _as(df, "tags", C.parse_tags),
    })
