"""Headline queries: median of BENCH_REPEATS runs after a warm-up, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from querent.session import local_session  # noqa: E402
from querent.suite import load_all  # noqa: E402
from querent.suite.registry import QUERIES  # noqa: E402

HEADLINE = [
    "d01_keep_longest", "d03_remove_near_duplicates", "t07_clean_lines", "g14_force_split", "v03_top_k",
    "p8_session_report", "t21_repetition_ratio", "g01_pairs_by_markers", "p3_parse_and_chunk", "q03_build_bank",
    "a03_score_summary", "p6_build_index",
]


def run(fn, spark, sf: str) -> float:
    start = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    load_all()
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        fn = QUERIES[name]
        warm = run(fn, spark, sf)
        runs = [run(fn, spark, sf) for _ in range(repeats)] or [warm]
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
