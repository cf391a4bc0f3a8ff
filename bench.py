"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs in full (every output row is computed and dropped) once cold and then warm; the warm times count,
the cold ones are listed apart.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.plans import catalogue  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

HEADLINE = (
    "flagship_hourly_levels", "f2_request_cost", "f4_budget_status", "f9_request_frequency", "n6_geoip_enrich", "e4_correlation_chain",
    "e8_route_topic", "s7_upsert_by_request_id", "c7_quality_scores", "p1_detect_pii", "p6_consent_as_of", "d1_health_streaks", "m2_rate",
    "m9_histogram_quantile", "a2_hold_for", "a5_inhibit", "q5_metrics_summary", "u1_reconcile_counts", "m21_record_rules",
    "a1_evaluate_rules",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "tidewatch-bench")
    names = sys.argv[1:] or HEADLINE
    cold, warm = {}, {}
    for times in (cold, warm):
        for name in names:
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold,
        "cold_total": round(sum(cold.values()), 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
