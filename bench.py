"""Times the headline queries on the given tables and prints one JSON line.

Each query is run once to warm up and then ``BENCH_RUNS`` times (default 3); the median counts. Results are
fully computed into the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tenorline import workload  # noqa: E402
from tenorline.session import local_session  # noqa: E402

HEADLINE = [
    "staging_last_value", "gap_fill_median", "merge_history", "latest_per_series", "yoy_rate", "qoq_annualised", "growth_summary", "anchor_windows",
    "taylor_rule", "reference_metrics", "scenario_grid", "ppp_path", "ppp_snapshot", "irp_tenors", "valuation_snapshot", "return_expectation",
    "return_comparison", "upsert_rows", "fetch_plan", "request_window",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("tenorline-bench", cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, driver_memory="12g")
    registered = workload.queries()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        timings = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(timings[1:]), 3)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cores": cores, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
