"""Row validation by declarative rules; bad rows are tagged, never dropped.

One projection computes the list of failed rules per row, so a frame of any size is
validated without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.operators.dedup import POINTER

Check = tuple[Column, str, Column]  # failed?, code, detail


@dataclass(frozen=True)
class Validated:
    """`judged` is the whole feed with `is_valid`, which is computed from the conditions alone.

    Whoever wants the valid rows, or counts, does not pay for the JSON, the lists and the texts of the others:
    those are made of the rows that are asked for, above whatever `judged` is kept in.
    """

    judged: DataFrame
    rules: dict

    @property
    def tagged(self) -> DataFrame:
        """The whole feed with `raw_data`, `is_valid`, `error_codes` and `error_details`."""
        return _described(self.judged, self.rules)

    @property
    def valid(self) -> DataFrame:
        return self.judged.filter("is_valid").drop("is_valid")

    @property
    def quarantined(self) -> DataFrame:
        bad = _described(self.judged.filter(~F.col("is_valid")), self.rules)
        pointer = [c for c in POINTER if c in bad.columns]
        return bad.select(*pointer, "raw_data", "error_codes", "error_details")

    def totals(self) -> DataFrame:
        """One row: total, valid and quarantined rows and the quarantine rate (0 if empty)."""
        bad = F.count_if(~F.col("is_valid"))
        return self.judged.agg(
            F.count("*").alias("total_rows"),
            (F.count("*") - bad).alias("valid_rows"),
            bad.alias("quarantined_rows"),
            F.coalesce(C.ratio(bad, F.count("*")), F.lit(0.0)).alias("quarantine_rate"),
        )


def _detail(template: str, *parts: Column) -> Column:
    return F.format_string(template, *parts) if parts else F.lit(template)


def _missing(name: str, c: Column) -> Check:
    failed = c.isNull() | (C.trimmed(c) == "")
    return failed, f"MISSING_{name.upper()}", F.lit(f"Required field '{name}' is missing or empty")


def _number(name: str) -> str:
    return f"_number_{name}"


def _format_checks(df: DataFrame, rules: dict) -> list[Check]:
    """Checks of the second step, in the order in which their codes are listed."""
    checks: list[Check] = []

    def given(names):
        return [(n, F.col(n)) for n in names if n in df.columns]

    for name, c in given(rules.get("email", [])):
        checks.append((
            (c != "") & ~c.rlike(V.EMAIL_PATTERN), f"INVALID_EMAIL_{name.upper()}",
            _detail(f"'{name}' is not a valid email: %s", c),
        ))
    for name, c in given(rules.get("date", [])):
        checks.append((
            (F.trim(c) != "") & C.to_moment(c).isNull(), f"INVALID_DATE_{name.upper()}",
            _detail(f"'{name}' could not be parsed as a date: %s", c),
        ))
    for name, c in given(rules.get("non_negative", [])):
        number = F.col(_number(name))
        checks.append((
            (c != "") & number.isNull(), f"NOT_NUMERIC_{name.upper()}",
            _detail(f"'{name}' must be numeric, got %s", c),
        ))
        checks.append((
            (c != "") & (number < 0), f"NEGATIVE_{name.upper()}",
            _detail(f"'{name}' must be >= 0, got %s", number.cast("string")),
        ))
    for name, c in given(rules.get("range", {})):
        lo, hi = rules["range"][name]
        number = F.col(_number(name))
        checks.append((
            (c != "") & (F.isnan(number) | ~number.between(lo, hi)), f"OUT_OF_RANGE_{name.upper()}",
            _detail(f"'{name}' must be between {lo} and {hi}, got %s", number.cast("string")),
        ))
    for name, c in given(rules.get("enum", {})):
        allowed = rules["enum"][name]
        value = F.lower(F.trim(c))
        checks.append((
            (value != "") & ~value.isin(allowed), f"INVALID_ENUM_{name.upper()}",
            _detail(f"'{name}' must be one of {allowed}, got '%s'", value),
        ))
    return checks


def _failures(checks: list[Check]) -> Column:
    """Array of (code, detail) of the failed checks, in order."""
    found = [
        F.when(F.coalesce(failed, F.lit(False)),
               F.struct(F.lit(code).alias("code"), detail.alias("detail")))
        for failed, code, detail in checks
    ]
    empty = F.lit(None).cast("struct<code:string,detail:string>")
    return F.array_compact(F.array(*(found or [empty])))


def _any(checks: list[Check]) -> Column:
    found = F.lit(False)
    for failed, _, _ in checks:
        found = found | F.coalesce(failed, F.lit(False))
    return found


def _with_numbers(df: DataFrame, rules: dict) -> DataFrame:
    numeric = {*rules.get("non_negative", []), *rules.get("range", {})}.intersection(df.columns)
    return df.withColumns({_number(n): C.to_float(F.col(n)) for n in sorted(numeric)})


def _required(df: DataFrame, rules: dict) -> list[Check]:
    return [_missing(n, C.first_present(df, n)) for n in rules["required"]]


def _described(judged: DataFrame, rules: dict) -> DataFrame:
    """Judged rows with their JSON, and the codes and texts of the rules that they fail."""
    feed = [c for c in judged.columns if c != "is_valid"]
    df = _with_numbers(judged.withColumn("raw_data", C.raw_json(judged, skip=(*POINTER, "is_valid"))), rules)
    tagged = (
        df.withColumn("_missing", _failures(_required(df, rules)))
        .withColumn("_failed", F.when(F.size("_missing") > 0, F.col("_missing"))
                    .otherwise(_failures(_format_checks(df, rules))))
        .withColumn("error_codes", F.col("_failed.code"))
        .withColumn("error_details", F.array_join(F.col("_failed.detail"), "; "))
    )
    return tagged.select(*feed, "raw_data", "is_valid", "error_codes", "error_details")


def validate(df: DataFrame, dataset: str, rules: dict | None = None) -> Validated:
    """Tag every row with the rules it fails.

    A row with a missing required value is reported for that alone; the other checks
    run on complete rows only.
    """
    rules = rules or V.RULES[dataset]
    feed = C.normalize_columns(df, "rules")
    df = _with_numbers(feed, rules)
    # As the result of a generator, the verdict is computed once per row. As a plain column it
    # would be copied, checks and all, into every filter on it, which makes code so large that
    # the JVM only interprets it.
    verdict = F.explode(F.array(~(_any(_required(df, rules)) | _any(_format_checks(df, rules)))))
    return Validated(df.select(*feed.columns, verdict.alias("is_valid")), rules)
