"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores and
``BENCH_RUNS`` how often each query runs after one warm-up (the median is reported).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import QUERIES  # noqa: E402
from check import session  # noqa: E402

HEADLINE = [
    "supplier_loo_season",
    "batting_season",
    "batting_overall",
    "bowling_season",
    "bowling_overall",
    "matchup_season_types",
    "matchup_overall",
    "batting_phase_season",
    "batter_running",
    "progression_by_ball",
    "batting_position",
    "dedupe_first_seq",
]


def once(spark, sf: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = session(cores)
    seconds = {}
    for name in names:
        once(spark, sf, name)
        seconds[name] = round(statistics.median(once(spark, sf, name) for _ in range(runs)), 3)
    total = round(sum(seconds.values()), 3)
    scale = Path(sf).name.removeprefix("sf")
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
