"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
Every query runs once unmeasured and once measured, and is written to the no-op sink in full.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cropspark import queries as registered
from cropspark.session import local_session

HEADLINE = [
    "job01_training_samples",
    "job02_prj01_field_features",
    "top03_triage_queue",
    "job05_src07_farmer_features",
    "job04_fn09_crop_health_report",
    "join04_label_join",
    "join05_nearest_radar",
    "join07_agg07_flt06_cohort_without_own_value",
    "agg06_win10_join09_prj04_twins",
    "win05_gap_filled_calendar",
    "ml06_set01_baseline_evaluation",
    "ml10_fn33_fn34_encoder_inputs",
    "ml08_ml09_publish_and_forecast",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "cropspark-bench")
    queries = registered.queries()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
