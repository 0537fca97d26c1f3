"""Plan audit of the registered queries.

    python -m checks.plan_audit [sf_dir] [key ...]

For each query the executed (AQE final) plan is inspected after a ``noop``
run: Parquet scans and their pushed filters, hash shuffles, broadcasts,
sort-merge joins, nested-loop joins (the library's are one-row crosses) and
window operators (the library's unpartitioned ones run on per-day or
per-bucket rows only; tests/test_plans.py checks the metric windows).
"""

from __future__ import annotations

import re
import sys

from quarry.catalog import REGISTRY
from quarry.session import build_session


def audit(plan: str) -> dict:
    return {
        "scans": plan.count("FileScan parquet"),
        "pushed": len(re.findall(r"PushedFilters: \[[^\]]+\]", plan)),
        "shuffles": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning"),
        "single_partition": plan.count("Exchange SinglePartition"),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bnlj": plan.count("BroadcastNestedLoopJoin"),
        "windows": len(re.findall(r"(?m)^\W*Window ", plan)),
    }


def main(argv: list[str]) -> None:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(REGISTRY)
    spark = build_session()
    print(f"{'query':28s} scans pushed shuffles single bcast smj bnlj windows")
    for k in keys:
        df = REGISTRY[k](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        a = audit(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        print(f"{k:28s} {a['scans']:5d} {a['pushed']:6d} {a['shuffles']:8d} {a['single_partition']:6d} "
              f"{a['broadcasts']:5d} {a['smj']:3d} {a['bnlj']:4d} {a['windows']:7d}")


if __name__ == "__main__":
    main(sys.argv[1:])
