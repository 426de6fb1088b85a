"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is timed end to end with a no-op sink (the full plan runs, nothing
is collected); the value is the sum of per-query medians of BENCH_REPS (3) runs
after one warm-up run of the flagship. BENCH_QUERIES: names, or ``all``.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from arborform.plans.catalog import QUERIES  # noqa: E402
from arborform.session import get_session  # noqa: E402

HEADLINE = ["features", "layout_leaves", "markup_leaves", "node_leaves", "vocab", "token_ids",
            "align_mask", "pair_features", "mask_eval", "fuse_sum", "half_split", "batch_ids",
            "metric_row"]
ROWS_FOR = {"features": "documents", "layout_leaves": "documents", "markup_leaves": "pages",
            "pair_features": "documents"}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, driver_memory="20g")

    def run(name):
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    run("features")  # warm-up (JIT, file listing)
    times = {}
    for name in names:
        times[name] = round(statistics.median(run(name) for _ in range(reps)), 3)
    rows = {}
    for name, table in ROWS_FOR.items():
        if name in times:
            n = spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet")).count()
            rows[f"{name}_rows_per_s"] = round(n / times[name], 1)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None,
                      "cpus": int(cpus), "reps": reps, **rows}))
    spark.stop()


if __name__ == "__main__":
    main()
