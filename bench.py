"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full with a ``noop`` write (the whole plan runs,
nothing is collected) after one untimed warm-up query. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.catalog import REGISTRY  # noqa: E402
from quarry.session import build_session  # noqa: E402

HEADLINE = [
    "gross_profit_report", "revenue_trend", "arpu_daily", "arpu_running",
    "new_user_revenue_share", "product_revenue_share", "dau", "wau", "mau",
    "orders_delivered", "bonus_couriers",
    "duplicate_rows", "unique_violations", "partition_counts", "row_index",
    "describe", "group_stats", "impute_group_median", "clean_old_price", "box_stats",
    "mann_whitney_u", "shapiro_wilk", "spearman_matrix",
    "knn_classify", "knn_regress", "linear_regression", "tree",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                          app_name="quarry-bench")
    REGISTRY["dau"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    timings: dict[str, float] = {}
    for name in only or HEADLINE:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings,
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
