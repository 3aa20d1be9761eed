"""Time the headline queries: one warm-up, then the median of three runs, results discarded.

Reads ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``), runs on ``local[BENCH_CPUS]`` and
prints one JSON line. ``python bench.py name …`` times other registered queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from checks.queries import QUERIES
from reposift.session import local_session

HEADLINE = [
    "parse_projects",
    "load_project_queue",
    "load_queue_merging",
    "claim",
    "mark_completed",
    "mark_error",
    "reset_errors",
    "queue_report",
    "scan_commits",
    "scan_commits_of_large_repos",
    "file_history",
    "file_history_of_extensions",
    "resolve_attempts",
    "read_split",
    "consolidate",
    "lookup_contents",
    "crawl_commit_messages",
    "crawl_file_history",
    "crawl_file_contents",
]


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = [seconds(lambda: QUERIES[name](spark, sf_dir)) for _ in range(4)]
        times[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "sum of warm medians of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
