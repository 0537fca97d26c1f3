"""Physical-plan checks: the shapes the library promises at scale."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.joins import not_in, sized_broadcast
from quarry.plans import quality as qa
from quarry.plans import profit as pro
from quarry.operators import ranks
from quarry.sources import files as fs
from quarry.sources import tables as tb
from tests.conftest import SF001, SF01


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.set("spark.sql.adaptive.enabled", aqe)


def test_not_in_is_a_shuffle_anti_join(spark, no_auto_broadcast):
    orders = tb.table(spark, SF01, "orders")
    cancelled = orders.where(F.col("o_orderstatus") == "F").select("o_orderkey")
    p = plan(not_in(orders, "o_orderkey", cancelled, "o_orderkey"))
    assert "SortMergeJoin" in p and "LeftAnti" in p
    assert "BroadcastHashJoin" not in p          # the literal NOT IN would broadcast the set


def test_sized_broadcast_respects_limit(spark):
    part = tb.table(spark, SF01, "part")
    assert "broadcast" in str(sized_broadcast(part)._jdf.queryExecution().logical()).lower() or \
        "ResolvedHint" in str(sized_broadcast(part)._jdf.queryExecution().analyzed())
    big = sized_broadcast(part, limit=1)
    assert "ResolvedHint" not in str(big._jdf.queryExecution().analyzed())


def test_scan_prunes_columns_and_pushes_filters(spark):
    s = tb.shop(spark, SF01)
    p = plan(pro.orders_delivered(s))
    # only the three lineitem columns the count needs are read
    assert "ReadSchema: struct<l_orderkey:bigint,l_linestatus:string,l_shipdate:timestamp_ntz>" in p
    assert "EqualTo(o_orderstatus,F)" in plan(s.cancelled)


@pytest.mark.parametrize("report", ["arpu_daily", "arpu_running", "new_user_revenue_share", "gross_profit_report"])
def test_reports_read_each_table_once(spark, report):
    from quarry.plans import revenue as rev
    df = getattr(rev, report, None) or getattr(pro, report)
    out = df(tb.shop(spark, SF001))
    out.collect()
    final = plan(out).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= 4


def test_daily_windows_sit_on_aggregates(spark):
    from quarry.plans import revenue as rev
    p = rev.revenue_trend(tb.shop(spark, SF01))._jdf.queryExecution().optimizedPlan().toString()
    window_at = p.index("Window [")
    assert "Aggregate" in p[window_at:]            # the window's input is the per-day aggregate


def test_no_percentile_in_rank_based_jobs(spark):
    items = tb.items(spark, SF001)
    from quarry.plans import profile as pf
    p = plan(pf.describe(items, ["price", "depth"]))
    assert "percentile(" not in p.lower()


def test_duplicate_rows_with_hot_key(spark):
    rng = np.random.default_rng(2)
    n = 3000
    keys = np.where(rng.random(n) < 1 / 3, 7, rng.integers(0, 100000, n))   # one key holds a third
    df = spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys)], "id long, k long")
    got = {r["id"] for r in qa.duplicate_rows(df, ["k"]).collect()}
    _, inv, cnt = np.unique(keys, return_inverse=True, return_counts=True)
    want = {i for i in range(n) if cnt[inv[i]] > 1}
    assert got == want


def test_row_index_with_hot_leading_value(spark):
    rng = np.random.default_rng(4)
    rows = [(int(7 if rng.random() < 0.4 else rng.integers(0, 50)), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = [r["index"] for r in fs.with_row_index(df, ["a", "b"]).orderBy("a", "b").collect()]
    assert got == list(range(2000))


def test_value_positions_hot_value_is_one_row(spark):
    df = spark.createDataFrame([(5.0,)] * 1000 + [(float(i),) for i in range(100)], "v double")
    pos = {r["x"]: (r["t"], r["start"]) for r in ranks.value_positions(df, "v", buckets=4).collect()}
    assert pos[5.0] == (1001, 5)
    assert pos[6.0] == (1, 1006)
