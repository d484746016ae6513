from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import narrative

KPI = ("headcount long, utilization double, absences long, overtime double, demand_coverage double, "
       "tickets long, open_tickets long, breaches long, avg_resolution double, prior_tickets long, "
       "ticket_change_pct double, breach_rate double, period_start date, period_end date")


def kpis(spark, **changed):
    row = {
        "headcount": 10, "utilization": 80.0, "absences": 0, "overtime": 0.0, "demand_coverage": 90.0,
        "tickets": 100, "open_tickets": 5, "breaches": 0, "avg_resolution": 3.25, "prior_tickets": 100,
        "ticket_change_pct": 0.0, "breach_rate": 0.0, "period_start": date(2024, 1, 1),
        "period_end": date(2024, 1, 31), **changed}
    return spark.createDataFrame([tuple(row.values())], KPI)


def told(spark, role="analyst", **changed):
    return narrative.narrative(kpis(spark, **changed), role).first()


def test_quiet_period(spark):
    row = told(spark)
    assert row.period == "Jan 01 – Jan 31, 2024"
    assert row.headline == "Operations within normal parameters — minor optimizations available"
    assert row.key_findings == [
        "Workforce utilization averaged 80.0% over the period (10 active employees tracked)."]
    assert row.alerts == [] and row.recommendations == []
    assert row.summary == (
        "For the period Jan 01 – Jan 31, 2024, the organization tracked 10 employees at 80.0% utilization "
        "with 100 support tickets raised (5 still open). Average ticket resolution time was 3.3 hours "
        "with a 0.0% SLA breach rate.")


@pytest.mark.parametrize("changed, headline", [
    ({"breach_rate": 26.0, "ticket_change_pct": 16.0}, "High demand surge"),
    ({"breach_rate": 26.0, "ticket_change_pct": 15.0}, "SLA performance below target"),
    ({"breach_rate": 25.0, "ticket_change_pct": 16.0}, "Support volume trending up"),
    ({"utilization": 95.1}, "Workforce at near-maximum"), ({"utilization": 59.9}, "Operational capacity"),
    ({"utilization": 95.0}, "Operations within normal")])
def test_headlines(spark, changed, headline):
    assert told(spark, **changed).headline.startswith(headline)


def test_alerts_and_advice(spark):
    row = told(spark, utilization=96.0, ticket_change_pct=12.4, prior_tickets=89, breach_rate=21.0,
               demand_coverage=104.6, overtime=150.0)
    assert row.alerts == [
        "Support demand rose 12% period-over-period (100 tickets vs 89 prior).",
        "SLA breach rate reached 21.0% — exceeds the 20% warning threshold.",
        "Workforce is operating at 96.0% utilization — over-capacity risk.",
        "Demand (105% of capacity) is outpacing available staff headcount."]
    assert len(row.recommendations) == 3
    assert row.key_findings[-1] == "Overtime hours totalled 150h — monitor for burnout signals."


def test_findings_for_falling_demand(spark):
    row = told(spark, ticket_change_pct=-20.0, breach_rate=5.5, utilization=50.0)
    assert row.key_findings[1:] == [
        "Support demand decreased 20% period-over-period.", "SLA compliance at 94.5%.",
        "Utilization at 50.0% suggests available capacity — review scheduling efficiency."]


def test_executive_sees_less(spark):
    loud = {"utilization": 96.0, "ticket_change_pct": 12.0, "breach_rate": 21.0,
            "demand_coverage": 104.0, "overtime": 150.0}
    row = told(spark, "executive", **loud)
    assert (len(row.key_findings), len(row.alerts), len(row.recommendations)) == (2, 2, 2)
    with pytest.raises(ValueError, match="role_level"):
        told(spark, "god_mode")


def weekly(spark, **changed):
    row = {"avg_utilization_pct": 80.0, "absence_rate_pct": 5.0, "staffing_change_pct": 0.0,
           "demand_change_pct": 0.0, "volume_change_pct": 0.0, "sla_breach_pct": 5.0,
           "avg_resolution_hours": 10.0, "total_tickets_this_week": 50, **changed}
    schema = ", ".join(f"{k} {'long' if k.startswith('total') else 'double'}" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema)


def keys(df):
    return [(r.metric_key, r.severity) for r in df.orderBy("position").collect()]


def test_workforce_cards(spark):
    assert keys(narrative.workforce_insights(weekly(spark))) == [("utilization", "info")]
    loud = weekly(spark, demand_change_pct=25.0, staffing_change_pct=5.0, avg_utilization_pct=96.0,
                  absence_rate_pct=11.0)
    assert keys(narrative.workforce_insights(loud)) == [
        ("staffing_gap", "alert"), ("utilization", "alert"), ("absence_rate", "warning")]
    over = narrative.workforce_insights(weekly(spark, staffing_change_pct=15.0, avg_utilization_pct=50.0))
    assert keys(over) == [("staffing_overage", "warning"), ("utilization", "warning")]
    gap = narrative.workforce_insights(loud).filter("metric_key = 'staffing_gap'").first()
    assert gap.change_pct == 20.0 and gap.body == (
        "Demand rose 25.0% week-over-week while staffing rose only 5.0%. "
        "A 20.0pp gap may strain capacity and increase SLA risk.")


def test_unknown_measures_give_no_card(spark):
    unknown = weekly(spark, staffing_change_pct=None, avg_utilization_pct=None, absence_rate_pct=None)
    assert keys(narrative.workforce_insights(unknown)) == []


def test_ticket_cards_and_top_alerts(spark):
    loud = weekly(spark, volume_change_pct=21.0, sla_breach_pct=16.0, avg_resolution_hours=49.0,
                  demand_change_pct=21.0, avg_utilization_pct=96.0)
    assert keys(narrative.ticket_insights(loud)) == [
        ("ticket_volume", "alert"), ("sla_breach", "alert"), ("resolution_time", "warning")]
    assert keys(narrative.ticket_insights(weekly(spark, volume_change_pct=-16.0))) == [
        ("ticket_volume", "info")]
    top = narrative.top_alerts(loud, limit=3).orderBy("position").collect()
    assert [(r.source, r.metric_key) for r in top] == [
        ("workforce", "staffing_gap"), ("workforce", "utilization"), ("tickets", "ticket_volume")]


def test_executive_summary_lines(spark):
    row = narrative.executive_summary(weekly(spark, volume_change_pct=12.5), F.lit(2)).first()
    assert row.summary == (
        "**Operations Summary**\n\n- Workforce utilization: **80.0%**\n"
        "- Ticket volume this week: **50** (+12.5% WoW)\n- SLA compliance: **95.0%**\n"
        "- Active anomalies flagged: **2** — review recommended")
    bare = weekly(spark, avg_utilization_pct=None, total_tickets_this_week=0, sla_breach_pct=None)
    assert narrative.executive_summary(bare).first().summary == "**Operations Summary**\n"


def test_period_kpis_without_any_rows(spark):
    hours = spark.createDataFrame([], "employee_id string, date date, utilization_rate double, "
                                  "absent boolean, overtime_hours double, demand_units double, "
                                  "capacity_units double")
    tickets = spark.createDataFrame([], "created_date date, status string, sla_breached boolean, "
                                    "actual_resolution_hours double, sentiment_score double")
    row = narrative.period_kpis(hours, tickets, "2024-01-01", "2024-01-31").first()
    assert (row.headcount, row.tickets, row.ticket_change_pct, row.utilization) == (0, 0, 0.0, 0.0)
    assert narrative.narrative(narrative.period_kpis(hours, tickets, "2024-01-01", "2024-01-31")).count() == 1
