"""Dimension members: built from what the facts mention, inserted only when missing.

Keys are hashes of the natural key, so a fact row gets its key without a lookup join and
without a counter that all tasks would have to share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.functions import timeparts as T
from tidewatch.operators.dedup import ROW_INDEX, dedup


def member_key(*natural: str | Column) -> Column:
    return F.xxhash64(*natural)


def absent_from(new: DataFrame, existing: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` whose key `existing` does not hold; rows with a NULL key always stay."""
    if existing is None:
        return new
    return new.join(existing.select(*keys), list(keys), "left_anti")


def build_dim_date(dates: DataFrame, column: str, existing: DataFrame | None = None) -> DataFrame:
    """One row per distinct date that is not in the dimension yet."""
    day = F.col("date")
    new = dates.select(F.col(column).cast("date").alias("date")).filter(day.isNotNull()).distinct()
    return absent_from(new, existing, ["date"]).select(
        T.date_id(day).alias("date_id"), "date",
        F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        T.monday_week(day).alias("week_of_year"),
        F.weekday(day).alias("day_of_week"), F.date_format(day, "EEEE").alias("day_name"),
        (F.weekday(day) >= 5).alias("is_weekend"), F.lit(False).alias("is_holiday"),
        T.fiscal_year(day).alias("fiscal_year"), T.fiscal_quarter(day).alias("fiscal_quarter"),
    )


def _codes(rows: DataFrame, column: str, default: str) -> DataFrame:
    code = F.coalesce(C.first_present(rows, column), F.lit(default))
    return rows.select(code.alias("code")).distinct()


def new_departments(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    codes = _codes(rows, "department_code", V.DEFAULT_DEPARTMENT)
    return absent_from(codes, existing, ["code"]).select(
        member_key("code").alias("department_key"), "code",
        C.title_case(F.col("code")).alias("name"),
    )


def new_locations(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    codes = _codes(rows, "location_code", V.DEFAULT_LOCATION)
    return absent_from(codes, existing, ["code"]).select(
        member_key("code").alias("location_key"), "code",
        C.title_case(F.col("code")).alias("city"),
        F.lit(V.LOCATION_COUNTRY).alias("country"),
        F.lit(V.LOCATION_TIMEZONE).alias("timezone"), F.lit(False).alias("is_remote"),
    )


def new_employees(
    rows: DataFrame, existing: DataFrame | None = None, order_by: Sequence[str] = (ROW_INDEX,)
) -> DataFrame:
    """Employees first seen in these rows; the first row of each gives its attributes."""
    first = dedup(rows, ["employee_id"], order_by=order_by)
    given = {n: F.coalesce(C.first_present(rows, n), F.lit(v))
             for n, v in V.EMPLOYEE_DEFAULTS.items()}
    default_email = F.concat(F.lower("employee_id"), F.lit(V.EMPLOYEE_EMAIL_DOMAIN))
    department = F.coalesce(C.first_present(rows, "department_code"), F.lit(V.DEFAULT_DEPARTMENT))
    location = F.coalesce(C.first_present(rows, "location_code"), F.lit(V.DEFAULT_LOCATION))
    return absent_from(first, existing, ["employee_id"]).select(
        member_key("employee_id").alias("employee_key"), "employee_id",
        *[c.alias(n) for n, c in given.items()],
        F.coalesce(C.first_present(rows, "email"), default_email).alias("email"),
        member_key(department).alias("department_key"), department.alias("department_code"),
        member_key(location).alias("location_key"), location.alias("location_code"),
        F.lit(True).alias("is_active"),
    )


def lookup(rows: DataFrame, dim: DataFrame, on: str, dim_key: str, take: dict[str, str]) -> DataFrame:
    """Left join with a dimension on its unique key; unknown members give NULL.

    No broadcast is forced: a dimension may be large (employees), and Spark broadcasts it by
    itself where its measured size is below spark.sql.autoBroadcastJoinThreshold.
    """
    side = dim.select(F.col(dim_key).alias("_key"), *[F.col(c).alias(n) for n, c in take.items()])
    return rows.join(side, F.col(on) == F.col("_key"), "left").drop("_key")
