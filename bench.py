"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion through the ``noop`` sink (the whole plan executes, nothing is
collected); the best of $BENCH_REPEAT runs is reported per query, ``value`` is their sum.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keelson.plans.registry import all_queries  # noqa: E402
from keelson.session import local_session  # noqa: E402

HEADLINE = [
    "j1_asof_bucketed",
    "j1_asof_unbucketed_left",
    "w1_sliding_global",
    "w1_sliding_by_user",
    "w2_row_index",
    "j3_next_row",
    "w3_gap_fill",
    "a1_log_loss",
    "f7_token_counts",
    "f9_f10_featurize_rows",
    "l4_parallel_cv",
    "s1_event_dump_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, 2 * int(cpus) if cpus.isdigit() else 16))))
    spark = local_session(cpus, shuffle_partitions=parts, app="keelson-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = all_queries()
    names = only or HEADLINE
    # warm-up: JIT and the parquet footer cache, not counted
    qs["a6_row_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    # a fixed piece of work beside them, which tells a slow machine from slow code
    t0 = time.perf_counter()
    spark.range(0, 200_000_000, 1, 8).selectExpr("bit_xor(xxhash64(id)) AS x").collect()
    calibration = round(time.perf_counter() - t0, 3)
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "shuffle_partitions": parts,
                      "calibration_sec": calibration}))
    spark.stop()


if __name__ == "__main__":
    main()
