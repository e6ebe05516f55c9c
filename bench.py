"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
input and the local cores.  Each query is run to its full result through the
``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigipanel.plans.catalog import QUERIES  # noqa: E402
from vigipanel.session import local_session  # noqa: E402

HEADLINE = [
    "annual_incidence", "monthly_series", "weekly_series", "record_coverage", "annual_summary", "annual_extremes",
    "duplicate_providers", "indicator_coverage", "survey_panel", "lag_associations", "leave_one_out", "ols_two_way",
    "moran_global", "moran_local", "knn4_points", "active_outflow", "dq_reference", "normalise_names",
    "dq_credentials",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session("bench")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
