"""Named queries against their SQL; TIDEWATCH_ALL=1 runs every one of them."""

import os

import pytest

from tests.oracle_check import check, connect
from tidewatch.plans import all_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUERIES, ORACLES = all_queries()

# one or two of every family
SAMPLE = [
    "a1_read_csv_feed", "a3_read_json_feed", "a6_insert_tickets_if_absent", "a8_upsert_employees",
    "a9_insert_operations_ignore_conflicts", "a14_ingestion_runs", "b20_split_invalid",
    "b30_clean_workforce", "b31_clean_tickets", "b33_clean_employees", "b35_clean_ticket_records",
    "c0_validate_employees", "c0_validate_market_signals", "d4_dedup_operations_last",
    "e1_build_dim_date", "e5_lookup_members", "g1_workforce_summary", "g2_workforce_by_department",
    "g5_staffing_gaps", "g8_ticket_trends", "g10_sla_report", "g12_market_signals",
    "g13_workforce_overview", "g17_tickets_daily_volume", "g19_weekly_kpis",
    "h3_rolling_std", "k1_heatmap_matrix", "l2_ridge_forecast", "l6_build_points",
    "l10_zscore_exclude_self", "l11_iqr_anomalies", "l15_reasons_workforce",
    "m2_findings_alerts_recommendations", "m9_top_alerts", "s1_stream_ingest",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("TIDEWATCH_ALL") else SAMPLE)
def test_query_agrees_with_its_sql(spark, con, name):
    difference, rows, _ = check(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert not difference, difference
    assert rows > 0


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(ORACLES) == {
        "l5_holt_winters_forecast", "l13_multivariate_tickets", "l13_multivariate_workforce"}
