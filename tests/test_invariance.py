"""Same results for 1 and 64 shuffle partitions (floats to 1e-9)."""

import math

import pytest

from quarry.catalog import REGISTRY
from tests.conftest import SF001

KEYS = ["dau", "arpu_running", "gross_profit_report", "product_revenue_share", "duplicate_rows",
        "row_index", "describe", "impute_group_median", "mann_whitney_u", "spearman_matrix",
        "box_stats", "knn_accuracy_by_k", "label_encode"]


def _norm(rows):
    def key(t):
        return tuple((v is None, 0 if v is None else v) for v in t)
    return sorted((tuple(r) for r in rows), key=key)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


@pytest.mark.parametrize("name", KEYS)
def test_partition_count_invariance(spark, name):
    out = []
    for parts in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = REGISTRY[name](spark, SF001)
        out.append(_norm(df.select(*sorted(df.columns)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(out[0]) == len(out[1])
    for r1, r2 in zip(*out):
        assert all(_same(x, y) for x, y in zip(r1, r2)), (r1, r2)
