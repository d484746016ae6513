"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

    BENCH_SF_DIR   folder of the tables   (default /root/testdata/sf0.1)
    BENCH_CPUS     cores                  (default 8)
    BENCH_ALL      any value: every named query instead of the headline ones
    BENCH_REPEAT   timed runs per query, the best counts (default 2)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "b30_clean_workforce", "b31_clean_tickets", "c0_validate_operations", "e4_new_employees",
    "a6_insert_tickets_if_absent", "a10_upsert_tickets", "g1_workforce_summary",
    "g4_utilization_heatmap", "g5_staffing_gaps", "g8_ticket_trends", "g10_sla_report",
    "g12_market_signals", "g13_workforce_overview", "g19_weekly_kpis",
    "g11_series_all_by_department", "l2_ridge_demand_extrapolated", "l6_build_points",
    "l10_zscore_anomalies", "l11_iqr_anomalies", "l13_multivariate_workforce",
    "m2_findings_alerts_recommendations",
]


def main() -> None:
    from tidewatch.plans import all_queries
    from tidewatch.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = all_queries()[0]
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("g8_ticket_trends")  # warm the JVM up
    run("g1_workforce_summary")
    seconds = {name: round(min(run(name) for _ in range(repeat)), 3) for name in names}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
