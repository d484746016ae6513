"""Findings in plain words, as rows computed from rows of period measures.

Every function takes a frame with one row per period (and group) and gives sentences by
column expressions, so a thousand departments are one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import columns as C
from tidewatch.operators.periods import (
    CURRENT, PRIOR, as_date, change_pct, label_periods, of_period,
)
from tidewatch.operators.tickets import is_open
from tidewatch.operators.workforce import absence_rows_pct


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _sentences(*rules: tuple[Column, Column]) -> Column:
    """The sentences whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(holds, text) for holds, text in rules]))


def _say(template: str, *parts: Column) -> Column:
    return F.format_string(template, *parts) if parts else F.lit(template)


def _combine(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two frames of measures with one row per key side by side, without a join.

    Each measure is NULL in all but one of the rows of a key, so max picks its value.
    Without keys, both frames are one row and so is the result.
    """
    rows = left.unionByName(right, allowMissingColumns=True)
    picked = [F.max(c).alias(c) for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(*picked) if by else rows.agg(*picked)


# --- measures of a period against the one before -----------------------------------------
def period_kpis(
    hours: DataFrame, tickets: DataFrame, start, end, prior: str = "equal", by: Sequence[str] = ()
) -> DataFrame:
    """Workforce and ticket measures of start..end with the ticket count of the prior period.

    Both periods come from one scan of each fact: rows are labelled by period, and the
    measures are aggregated per label.
    """
    start, end = as_date(start), as_date(end)
    worked = hours.filter(F.col("date").between(F.lit(start), F.lit(end)))
    workforce = [
        F.count_distinct("employee_id").alias("headcount"),
        F.round(F.avg("utilization_rate") * 100, 9).alias("utilization"),
        F.count_if("absent").alias("absences"),
        F.round(F.sum("overtime_hours"), 6).alias("overtime"),
        F.avg("demand_units").alias("_demand"), F.avg("capacity_units").alias("_capacity"),
    ]
    wf = worked.groupBy(*by).agg(*workforce) if by else worked.agg(*workforce)
    wf = wf.withColumn("demand_coverage", _zero(F.when(
        F.col("_capacity") > 0, F.round(F.col("_demand") / F.col("_capacity") * 100, 9)))
    ).drop("_demand", "_capacity")

    measures = {
        "tickets": F.count("*"), "open_tickets": F.count_if(is_open()),
        "breaches": F.count_if("sla_breached"),
        "avg_resolution": F.round(F.avg("actual_resolution_hours"), 9),
        "avg_sentiment": F.round(F.avg("sentiment_score"), 9),
    }
    per = label_periods(tickets, "created_date", start, end, prior).groupBy(*by, "period").agg(
        *[m.alias(n) for n, m in measures.items()])
    both = [of_period(CURRENT, n).alias(n) for n in measures] + [
        of_period(PRIOR, "tickets").alias("prior_tickets")]
    tk = per.groupBy(*by).agg(*both) if by else per.agg(*both)

    joined = _combine(wf, tk, by).withColumns({
        "period_start": F.lit(start), "period_end": F.lit(end),
        **{c: F.coalesce(c, F.lit(0)) for c in
           ("headcount", "absences", "tickets", "open_tickets", "breaches", "prior_tickets")},
        **{c: _zero(F.col(c)) for c in
           ("utilization", "overtime", "demand_coverage", "avg_resolution")},
    })
    now, before = F.col("tickets"), F.col("prior_tickets")
    return joined.withColumns({
        "ticket_change_pct": _zero((now - before) / F.when(before > 0, before) * 100),
        "breach_rate": _zero(F.col("breaches") / F.when(now > 0, now) * 100),
    })


# --- period narrative -------------------------------------------------------------------------
def key_findings() -> Column:
    util, change = F.col("utilization"), F.col("ticket_change_pct")
    rate, overtime = F.col("breach_rate"), F.col("overtime")
    return _sentences(
        (F.lit(True), _say(V.FINDING_UTILIZATION, C.fixed(util, 1), F.col("headcount"))),
        (change < -10, _say(V.FINDING_DEMAND_DOWN, C.fixed(F.abs(change), 0))),
        ((rate > 0) & (rate <= 20), _say(V.FINDING_COMPLIANCE, C.fixed(100 - rate, 1))),
        (util < 60, _say(V.FINDING_CAPACITY, C.fixed(util, 1))),
        (overtime > 100, _say(V.FINDING_OVERTIME, C.fixed(overtime, 0))),
    )


def alerts() -> Column:
    util, change = F.col("utilization"), F.col("ticket_change_pct")
    rate, coverage = F.col("breach_rate"), F.col("demand_coverage")
    return _sentences(
        (change > 10, _say(V.ALERT_DEMAND, C.fixed(change, 0), F.col("tickets"), F.col("prior_tickets"))),
        (rate > 20, _say(V.ALERT_BREACH, C.fixed(rate, 1))),
        (util > 95, _say(V.ALERT_UTILIZATION, C.fixed(util, 1))),
        (coverage > 100, _say(V.ALERT_COVERAGE, C.fixed(coverage, 0))),
    )


def recommendations() -> Column:
    return _sentences(
        (F.col("ticket_change_pct") > 10, F.lit(V.ADVICE_DEMAND)),
        (F.col("breach_rate") > 20, F.lit(V.ADVICE_BREACH)),
        (F.col("utilization") > 95, F.lit(V.ADVICE_UTILIZATION)),
    )


def headline() -> Column:
    util, change, rate = F.col("utilization"), F.col("ticket_change_pct"), F.col("breach_rate")
    return (
        F.when((rate > 25) & (change > 15), V.HEADLINE_SURGE).when(rate > 25, V.HEADLINE_BREACH)
        .when(change > 15, V.HEADLINE_DEMAND).when(util > 95, V.HEADLINE_OVER)
        .when(util < 60, V.HEADLINE_UNDER).otherwise(V.HEADLINE_NORMAL)
    )


def period_label() -> Column:
    return F.concat(F.date_format("period_start", "MMM dd"), F.lit(" – "),
                    F.date_format("period_end", "MMM dd, yyyy"))


def role_filter(narrative: DataFrame, role_level: str) -> DataFrame:
    """Executives see the first 3 findings, 2 alerts and 2 recommendations; others see all."""
    if role_level not in V.ROLE_LEVELS:
        raise ValueError(f"role_level must be one of {V.ROLE_LEVELS}, got {role_level!r}")
    narrative = narrative.withColumn("role_level", F.lit(role_level))
    if role_level != "executive":
        return narrative
    kept = {"key_findings": 3, "alerts": 2, "recommendations": 2}
    return narrative.withColumns({c: F.slice(c, 1, n) for c, n in kept.items()})


def narrative(kpis: DataFrame, role_level: str = "analyst", by: Sequence[str] = ()) -> DataFrame:
    """Headline, summary and lists of sentences per row of `period_kpis`."""
    summary = _say(
        V.NARRATIVE_SUMMARY, F.col("period"), F.col("headcount"), C.fixed(F.col("utilization"), 1),
        F.col("tickets"), F.col("open_tickets"), C.fixed(F.col("avg_resolution"), 1),
        C.fixed(F.col("breach_rate"), 1))
    told = kpis.withColumn("period", period_label()).select(
        *by, "period", headline().alias("headline"), summary.alias("summary"),
        key_findings().alias("key_findings"), alerts().alias("alerts"),
        recommendations().alias("recommendations"))
    return role_filter(told, role_level)


# --- weekly measures and insight cards -------------------------------------------------------
def weekly_kpis(
    hours: DataFrame, tickets: DataFrame, end, by: Sequence[str] = ()
) -> DataFrame:
    """The eight days up to `end` against the seven before, from records of the record load."""
    end = as_date(end)
    start = end - timedelta(days=7)

    def both(rows: DataFrame, day: str, measures: dict[str, Column], prior: dict[str, str]):
        per = label_periods(rows, day, start, end, "insights").groupBy(*by, "period").agg(
            *[m.alias(n) for n, m in measures.items()])
        picked = [of_period(CURRENT, n).alias(n) for n in measures] + [
            of_period(PRIOR, n).alias(alias) for n, alias in prior.items()]
        return per.groupBy(*by).agg(*picked) if by else per.agg(*picked)

    wf = both(hours, "date", {
        "avg_utilization_pct": C.rounded(F.avg("utilization_pct"), 1),
        "absence_rate_pct": absence_rows_pct(),
        "headcount": F.count_distinct("employee_code"),
    }, {"headcount": "prev_headcount"})
    tk = both(tickets, "created_date", {
        "total_tickets_this_week": F.count("*"),
        "sla_breach_pct": F.round(C.ratio(100.0 * F.count_if("sla_breached"), F.count("*")), 1),
        "avg_resolution_hours": C.rounded(F.avg("resolution_minutes") / 60.0, 1),
    }, {"total_tickets_this_week": "prev_tickets"})

    counts = ("headcount", "prev_headcount", "total_tickets_this_week", "prev_tickets")
    joined = _combine(wf, tk, by).withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    volume = change_pct(F.col("total_tickets_this_week"), F.col("prev_tickets"))
    return joined.withColumns({
        "staffing_change_pct": change_pct(F.col("headcount"), F.col("prev_headcount")),
        "volume_change_pct": volume, "demand_change_pct": volume,
    })


def _card(card: tuple, holds: Column, parts: Sequence[Column], value=None, change=None) -> Column:
    title, body, severity, key = card
    none = F.lit(None).cast("double")
    return F.when(holds, F.struct(
        F.lit(title).alias("title"), _say(body, *[C.fixed(p, 1) for p in parts]).alias("body"),
        F.lit(severity).alias("severity"), F.lit(key).alias("metric_key"),
        (none if value is None else value.cast("double")).alias("value"),
        (none if change is None else change.cast("double")).alias("change_pct")))


def workforce_cards() -> Column:
    staff, demand = F.col("staffing_change_pct"), F.col("demand_change_pct")
    util, absence = F.col("avg_utilization_pct"), F.col("absence_rate_pct")
    gap = demand - staff
    return F.array_compact(F.array(
        _card(V.INSIGHT_GAP, gap > 10, [demand, staff, gap], change=gap),
        _card(V.INSIGHT_OVERSTAFFED, gap < -10, [staff, demand], change=gap),
        _card(V.INSIGHT_UTIL_LOW, util < 60, [util], value=util),
        _card(V.INSIGHT_UTIL_HIGH, util > 95, [util], value=util),
        _card(V.INSIGHT_UTIL_OK, util.between(60, 95), [util], value=util),
        _card(V.INSIGHT_ABSENCE, absence > 10, [absence], value=absence),
    ))


def ticket_cards() -> Column:
    volume, breach = F.col("volume_change_pct"), F.col("sla_breach_pct")
    hours = F.col("avg_resolution_hours")
    return F.array_compact(F.array(
        _card(V.INSIGHT_VOLUME_UP, volume > 20, [volume], change=volume),
        _card(V.INSIGHT_VOLUME_DOWN, volume < -15, [F.abs(volume)], change=volume),
        _card(V.INSIGHT_BREACH, breach > 15, [breach], value=breach),
        _card(V.INSIGHT_RESOLUTION, hours > 48, [hours], value=hours),
    ))


def _insights(kpis: DataFrame, cards: Column, source: str, by: Sequence[str]) -> DataFrame:
    rows = kpis.select(*by, F.posexplode(cards).alias("position", "card"))
    return rows.select(*by, F.lit(source).alias("source"), "position", "card.*")


def workforce_insights(kpis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _insights(kpis, workforce_cards(), "workforce", by)


def ticket_insights(kpis: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _insights(kpis, ticket_cards(), "tickets", by)


def top_alerts(kpis: DataFrame, limit: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The first alerts, workforce before tickets; per group where `by` is given."""
    cards = F.concat(
        F.transform(workforce_cards(), lambda c: F.struct(F.lit("workforce").alias("source"), c.alias("card"))),
        F.transform(ticket_cards(), lambda c: F.struct(F.lit("tickets").alias("source"), c.alias("card"))))
    first = F.slice(F.filter(cards, lambda x: x["card"]["severity"] == "alert"), 1, limit)
    rows = kpis.select(*by, F.posexplode(first).alias("position", "_alert"))
    return rows.select(*by, "position", "_alert.source", "_alert.card.*")


def executive_summary(kpis: DataFrame, anomaly_count: Column | None = None, by: Sequence[str] = ()):
    """Markdown lines for the measures that are there."""
    util, volume = F.col("avg_utilization_pct"), F.col("total_tickets_this_week")
    change, breach = F.col("volume_change_pct"), F.col("sla_breach_pct")
    sign = F.when(change >= 0, "+").otherwise("")
    moved = F.when(F.coalesce(change, F.lit(0.0)) != 0, F.concat(
        F.lit(" ("), sign, C.fixed(change, 1), F.lit("% WoW)"))).otherwise("")
    flagged = F.lit(0) if anomaly_count is None else anomaly_count
    lines = F.concat_ws(
        "\n", F.lit(V.EXECUTIVE_HEADER),
        F.when(util != 0, _say(V.EXECUTIVE_UTILIZATION, C.fixed(util, 1))),
        F.when(volume != 0, F.concat(_say(V.EXECUTIVE_VOLUME, volume), moved)),
        F.when(breach.isNotNull(), _say(V.EXECUTIVE_COMPLIANCE, C.fixed(100 - breach, 1))),
        F.when(flagged > 0, _say(V.EXECUTIVE_ANOMALIES, flagged)),
    )
    return kpis.select(*by, lines.alias("summary"))
