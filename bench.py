"""Time the headline queries: one warm-up, then the median of three runs, each written to a sink that keeps nothing."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hubmetrics.queries import QUERIES  # noqa: E402
from hubmetrics.session import build_session  # noqa: E402

HEADLINE = [
    "station_metrics", "low_use_score", "scored_match", "shared_segments", "upsert_daily", "alias_match", "prune_window",
    "station_list_score_desc", "system_comparison", "normalize_names", "lines_normalized", "simplify", "match_summary",
    "moving_averages", "components", "stitch",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(3)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
