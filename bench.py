"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times; the median is reported. Every row of every
column is computed and discarded (``noop`` sink), so nothing is pruned away by a count.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attest.queries import QUERIES  # noqa: E402
from attest.session import local_session  # noqa: E402

HEADLINE = [
    "digest",
    "plan_uploads",
    "verify_digests",
    "checksum_listing",
    "redact",
    "check",
    "first_failure",
    "release_check",
    "screen_check",
    "group_rules",
    "duplicates",
    "report_gate",
    "reconcile_links",
    "verify_targets",
    "publication_plan",
    "option_drift",
    "dangling_edges",
    "expect_matrix",
    "mark_superseded",
    "latest_gate",
    "effective_release",
    "changed_only",
    "lookup_owned",
    "code_outcomes",
    "rate_limit",
    "request_counts",
    "search_index",
    "extract_assets",
    "stream_latest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("attest-bench")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
