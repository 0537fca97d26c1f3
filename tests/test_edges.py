"""Small, constant and repeated inputs: defined answers instead of errors."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.normal import norm_sf
from quarry.plans import models as md
from quarry.plans import stats as st
from quarry.sources import files as fs
from quarry.streaming.daily import run_dau


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


def test_normal_tail_against_erfc(spark):
    zs = [-9.0, -3.5, -3.0, -1.0, -1e-9, 0.0, 0.3, 1.96, 2.9999, 3.0, 3.0001, 5.0, 12.0, 30.0]
    got = {r.x: r.p for r in values(spark, zs).select("x", norm_sf("x").alias("p")).collect()}
    for z in zs:
        assert got[z] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-11)
    assert values(spark, [float("nan")]).select(norm_sf("x").alias("p")).first().p is None


def test_shapiro_small_and_constant(spark):
    # published example of five values worked by hand: weights from normal scores
    r = st.shapiro_wilk(values(spark, [1, 2, 4, 9, 10]), "x").first()
    assert r.w == pytest.approx(0.881, abs=2e-3) and 0.25 < r.p < 0.4
    r = st.shapiro_wilk(values(spark, [1, 2, 4]), "x").first()
    w = (0.5 ** 0.5 * 3) ** 2 / np.var([1, 2, 4]) / 3
    assert r.w == pytest.approx(w)
    assert r.p == pytest.approx(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    for xs in ([5] * 4, [5] * 40):
        r = st.shapiro_wilk(values(spark, xs), "x").first()
        assert r.w is None and r.p is None
    for n in (4, 6, 11, 12):
        r = st.shapiro_wilk(values(spark, [k ** 2 for k in range(n)]), "x").first()
        assert 0.7 < r.w < 1 and 0 < r.p < 1
    assert st.shapiro_wilk(values(spark, [1, 2]), "x").first().w is None


def test_mann_whitney_equal_values(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (1.0, "b")], "x double, g string")
    r = st.two_sided_p(st.mann_whitney_u(df, "x", "g", "a", "b")).first()
    assert (r.n1, r.n2, r.u1, r.z, r.p) == (1, 2, 1.0, 0.0, 1.0)


def test_metrics_of_a_constant_label(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    r = md.metrics(df, "m").first()
    assert r.rmse == pytest.approx(math.sqrt(0.5)) and r.r2 is None


@pytest.mark.parametrize("lateness", ["1 hour", "12 hours", "2 days"])
def test_streaming_dau_with_any_lateness(spark, lateness):
    rows = [(1, datetime(2024, 1, 1, 0, 5)), (2, datetime(2024, 1, 1, 9)), (3, datetime(2024, 1, 1, 10)),
            (1, datetime(2024, 1, 1, 20)), (1, datetime(2024, 1, 2, 1)), (9, datetime(2024, 1, 9))]
    log = spark.createDataFrame([(u, u, "create_order", t) for u, t in rows],
                                "user_id bigint, order_id bigint, action string, time timestamp_ntz")
    src, sink = fs.fresh_path(spark, "src"), fs.fresh_path(spark, "sink")
    for day in (1, 2, 9):  # arrivals in order, one append each
        log.where(F.dayofmonth("time") == day).coalesce(1).write.parquet(src, mode="append")
        run_dau(spark, src, sink, src + "-checkpoint", lateness)
    log.where(F.dayofmonth("time") == 9).selectExpr("user_id", "order_id", "action", "time + interval 9 days as time").write.parquet(
        src, mode="append")
    run_dau(spark, src, sink, src + "-checkpoint", lateness)
    got = {r.dt.day: r.dau for r in spark.read.parquet(sink).collect()}
    assert got[1] == 3 and got[2] == 1


def test_model_sizes_are_parameters(spark):
    data = spark.range(60).selectExpr("id", "double(id % 7) as a", "double(id % 5) as b", "double(id % 7 + id % 5) as label",
                                      "if(id % 4 = 0, 'test', 'train') as split")
    for kind, params in (("tree", {"maxDepth": 2}), ("forest", {"numTrees": 3, "maxDepth": 2}), ("gbt", {"maxIter": 2})):
        assert md.fit_predict(data, kind, ["a", "b"], **params).count() == 15
    assert md.SIZES["forest"]["numTrees"] == 100 and md.SIZES["gbt"] == {"maxIter": 100, "maxDepth": 3}


def test_tree_finds_the_best_split(spark):
    """A depth-1 tree splits where a brute-force search finds the least squared error."""
    xs = [1.0, 2.0, 3.0, 4.0, 10.0, 11.0, 12.0, 13.0]
    ys = [1.0, 1.5, 0.5, 1.0, 7.0, 8.0, 7.5, 7.7]
    data = spark.createDataFrame([(x, y, s) for x, y in zip(xs, ys, strict=True) for s in ("train", "test")], "a double, label double, split string")
    got = {r.a: r.prediction for r in md.fit_predict(data, "tree", ["a"], maxDepth=1).collect()}
    cut = min(range(1, 8), key=lambda c: np.var(ys[:c]) * c + np.var(ys[c:]) * (8 - c))
    for i, x in enumerate(xs):
        assert got[x] == pytest.approx(np.mean(ys[:cut] if i < cut else ys[cut:]))
