"""Time the headline queries and print one JSON line.

Each query is run once to warm up and then timed; the time is until all result
rows have arrived. Set BENCH_SF_DIR and BENCH_CPUS to choose input and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import queries as registered
from checks.compare import session

HEADLINE = (
    "completeness_columns", "missing_pattern", "type_consistency", "iqr_outliers",
    "zscore_outliers", "text_style", "distribution_quality", "duplicate_rows",
    "column_uniqueness", "timeliness_columns", "validity_formats", "business_rules",
    "functional_dependency", "correlation_matrix", "contingency", "profile_numeric",
    "profile_text", "monthly_series", "seasonal_decomposition", "remediate_ffill",
    "cluster_stats", "clusters", "anomaly_summary", "assessment_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = sys.argv[1:] or HEADLINE
    spark = session(cores)
    queries = registered.queries()
    seconds: dict[str, float] = {}
    for name in chosen:
        queries[name](spark, folder).collect()
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, folder).collect()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{seconds[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    spark.stop()
    line = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
        "cpus": int(cores) if cores.isdigit() else cores,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
