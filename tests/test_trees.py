"""Exact trees and least squares against plain Python and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.plans import models as ml
from quarry.plans import trees as tr


def brute(x, y, w, xt, depth=None, level=0):
    """Every split tried; predictions of ``xt``."""
    n = w.sum()
    mean = (w * y).sum() / n
    if (depth is not None and level >= depth) or y.min() == y.max():
        return np.full(len(xt), mean)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for v, up in zip(values[:-1], values[1:], strict=True):
            left = x[:, f] <= v
            nl, sl = w[left].sum(), (w * y)[left].sum()
            score = sl * sl / nl + ((w * y).sum() - sl) ** 2 / (n - nl)
            if best is None or score > best[0]:
                best = (score, f, (v + up) / 2)
    if best is None:
        return np.full(len(xt), mean)
    _, f, cut = best
    out = np.empty(len(xt))
    for side in (False, True):
        at, att = (x[:, f] > cut) == side, (xt[:, f] > cut) == side
        out[att] = brute(x[at], y[at], w[at], xt[att], depth, level + 1)
    return out


def data(spark, n=240, seed=3, kinds=6):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, kinds, (n, 3)).astype(float) / 4
    y = (x[:, 0] * 8 - x[:, 1] * 4 + rng.integers(0, 3, n)).round()
    rows = [(*map(float, x[i]), float(y[i]), "test" if i % 4 == 0 else "train") for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c double, label double, split string"), x, y


@pytest.mark.parametrize("depth", [None, 0, 1, 2, 5])
def test_grow_equals_brute_force(depth):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60):
        x, y = rng.integers(0, 5, (n, 3)).astype(float), rng.integers(0, 6, n).astype(float)
        w, xt = rng.integers(1, 4, n).astype(float), rng.integers(0, 5, (30, 3)).astype(float)
        got = tr.walk(tr.grow(x, y, w, depth), xt)
        assert np.allclose(got, brute(x, y, w, xt, depth))


@pytest.mark.parametrize("local_rows", [100_000, 40, 1])
@pytest.mark.parametrize("depth", [None, 2])
def test_distributed_levels_equal_local_ones(spark, local_rows, depth):
    df, x, y = data(spark)
    test = np.arange(len(y)) % 4 == 0
    want = brute(x[~test], y[~test], np.ones((~test).sum()), x[test], depth)
    got = tr.fit_predict(df, ["a", "b", "c"], max_depth=depth, local_rows=local_rows).collect()
    assert sorted((r.label, round(r.prediction, 9)) for r in got) == sorted(
        (a, round(b, 9)) for a, b in zip(y[test], want, strict=True))


def test_forest(spark):
    df, x, y = data(spark, 400, 8, 40)
    one = {r.rid: r for r in tr.fit_predict(df, ["a", "b", "c"], trees=12, bootstrap=True).collect()}
    two = {r.rid: r for r in tr.fit_predict(df.repartition(1).coalesce(1), ["a", "b", "c"], trees=12, bootstrap=True,
                                            local_rows=30).collect()}
    assert len(one) == len(two) == 100
    error = np.mean([(r.prediction - r.label) ** 2 for r in one.values()])
    assert error < 0.5 * np.var(y) and len({r.prediction for r in one.values()}) > 20


def test_copies_and_constant_nodes(spark):
    rows = [(1.0, 2.0, 3.0, 7.0, "train")] * 300 + [(1.0, 2.0, 3.0, 8.0, "train")] * 100 + [(2.0, 2.0, 3.0, 1.0, "train")]
    rows += [(1.0, 2.0, 3.0, 0.0, "test"), (5.0, 2.0, 3.0, 0.0, "test")]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, split string")
    for local_rows in (10, 10_000):  # the copies cannot be split
        got = sorted(r.prediction for r in tr.fit_predict(df, ["a", "b", "c"], local_rows=local_rows).collect())
        assert got == [1.0, 7.25]
    none = df.where("split = 'nothing'")
    assert tr.fit_predict(none, ["a", "b", "c"]).count() == 0
    assert tr.fit_predict(df.where("split = 'train'"), ["a", "b", "c"]).count() == 0


def test_least_squares_equals_numpy(spark):
    df, x, y = data(spark, 300, 5, 30)
    df = df.withColumn("d", F.lit(4.0)).withColumn("e", F.col("a") + F.col("b"))
    test = np.arange(len(y)) % 4 == 0
    design = np.c_[np.ones(len(y)), x]
    beta, *_ = np.linalg.lstsq(design[~test], y[~test], rcond=None)
    got = ml.least_squares(df, ["a", "b", "c", "d", "e"]).collect()  # d constant, e a sum of others
    assert np.allclose(sorted(r.prediction for r in got), sorted(design[test] @ beta))
    assert ml.least_squares(df.where("split = 'test'"), ["a"]).where("prediction is not null").count() == 0


def test_bins_are_cut_again_until_exact(spark, monkeypatch):
    """Uneven values, few rows taken one by one, few nodes in a pass: the splits are the best ones still."""
    monkeypatch.setattr(tr, "DIRECT", 4)
    monkeypatch.setattr(tr, "NODES", 2)
    monkeypatch.setattr(tr, "BINS", 64)
    rng = np.random.default_rng(11)
    n = 600
    x = np.c_[np.exp(rng.normal(0, 6, n)), rng.integers(0, 9, n), -np.exp(rng.normal(0, 3, n))]
    y = (np.log(x[:, 0]) * 3 + x[:, 1] + rng.normal(0, 2, n)).round()
    test = np.arange(n) % 4 == 0
    df = spark.createDataFrame([(*map(float, x[i]), float(y[i]), "test" if test[i] else "train") for i in range(n)],
                               "a double, b double, c double, label double, split string")
    want = brute(x[~test], y[~test], np.ones((~test).sum()), x[test], 3)
    got = tr.fit_predict(df, ["a", "b", "c"], max_depth=3, local_rows=20).collect()
    assert sorted((r.label, round(r.prediction, 9)) for r in got) == sorted(
        (a, round(b, 9)) for a, b in zip(y[test], want, strict=True))


def test_bound_of_a_bin_holds():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, a, b = 60, *sorted(rng.integers(0, 61, 2))
        y = np.round(rng.normal(0, 5, n) ** 3)
        sums = np.r_[0.0, np.cumsum(y)]
        inside = y[a:b]
        if not len(inside):
            continue
        one = [np.array([float(v)]) for v in (n, y.sum(), a, sums[a], b - a, inside.sum(), inside.min(), inside.max())]
        most = max((sums[i] ** 2 / i + (sums[n] - sums[i]) ** 2 / (n - i) for i in range(max(a, 1), min(b, n - 1) + 1)), default=0)
        assert tr._greatest(*one)[0] >= most * (1 - 1e-9)


def test_large_nodes_send_bins_not_rows(spark):
    """What the split search shuffles: bins and the values of the last few bins, not every value of every feature."""
    from pyspark.sql import functions as F

    n = 30_000
    rows = spark.range(n).select(F.lit(0).alias("g"), F.array(F.rand(1), F.rand(2)).alias("x"), F.lit(1).alias("w")).withColumn(
        "y", F.round(F.get("x", F.lit(0)) * 100 + F.rand(3)))
    from quarry.session import cut_lineage
    rows = cut_lineage(rows)
    sent = []
    inside = tr._inside

    def counting(told, features):
        run = inside(told, features)
        sent.append(sum(r.n for r in rows.mapInArrow(run, "bin long, v double, w double, wy double").groupBy().agg(
            F.count("*").alias("n")).collect()))
        return run

    tr._inside = counting
    try:
        (g, f, cut), = tr.best_splits(rows, [(n, rows.agg(F.sum("y")).first()[0], [0.0, 0.0], [1.0, 1.0])], 2)
    finally:
        tr._inside = inside
    assert (g, f) == (0, 0) and 0.4 < cut < 0.6
    assert sum(sent) < 0.1 * 2 * n


def test_forest_grown_in_tasks_equals_the_levels_on_the_executors(spark, monkeypatch):
    """Rows that fit a task are not copied for every tree, and give the same forest."""
    df, x, y = data(spark, 400, 8, 12)
    df = df.repartition(3)
    asked = dict(features=["a", "b", "c"], trees=7, bootstrap=True)
    monkeypatch.setattr(tr, "PACK_ROWS", 50)
    monkeypatch.setattr(tr, "BLOCK", 16)

    def trees_of_rows(*_):
        raise AssertionError("rows were copied for every tree")

    with monkeypatch.context() as held:
        held.setattr(tr, "_Top", trees_of_rows)
        for depth in (None, 3):
            one = sorted((r.rid, r.label, round(r.prediction, 9)) for r in tr.fit_predict(df, max_depth=depth, **asked).collect())
            with monkeypatch.context() as far:
                far.setattr(tr, "PACKED", 0)
                far.setattr(tr, "_Top", LEVELS)
                two = sorted((r.rid, r.label, round(r.prediction, 9)) for r in tr.fit_predict(
                    df, max_depth=depth, local_rows=60, **asked).collect())
            assert len(one) == 100 and one == two
    assert tr.fit_predict(df.where("split = 'train'"), **asked).count() == 0
    assert tr.fit_predict(df.where("split = 'test'"), **asked).count() == 0


LEVELS = tr._Top


def test_bootstrap_weights_are_those_of_spark(spark):
    rid = np.r_[np.arange(50), (1 << 33) + np.arange(50)]
    u = F.pmod(F.xxhash64(F.lit(5), F.lit(41), "rid"), F.lit(1 << 53)) / float(1 << 53)
    want = [sum(r.u >= t for t in tr._poisson_steps()) for r in spark.createDataFrame(
        [(int(i),) for i in rid], "rid long").select("rid", u.alias("u")).orderBy("rid").collect()]
    assert tr.poisson(5, 41, rid).tolist() == want and 0.7 < np.mean(want) < 1.3


def test_grow_with_many_and_few_values_equals_brute_force():
    """A feature's values are summed up or its rows sorted: the splits are the same."""
    rng = np.random.default_rng(2)
    for n in (3, 50, 300):
        x = np.c_[rng.normal(0, 1, n).round(6), rng.integers(0, 3, n), rng.integers(0, 40, n)]
        y, w = (x[:, 0] * 5 + x[:, 1] + rng.normal(0, 3, n)).round(), rng.integers(1, 4, n).astype(float)
        xt = x[rng.integers(0, n, 80)] + rng.normal(0, 0.2, (80, 3)).round(2)
        assert np.allclose(tr.walk(tr.grow(x, y, w), xt), brute(x, y, w, xt))


def test_levels_store_the_rows_once(spark, monkeypatch):
    """Nodes are told by the splits so far: rows are stored once, equal ones as one, whatever the number of levels."""
    df, x, y = data(spark, 900, 6, 5)
    stored = []
    cut = tr.cut_lineage
    monkeypatch.setattr(tr, "cut_lineage", lambda rows: stored.append(cut(rows)) or stored[-1])
    test = np.arange(len(y)) % 4 == 0
    want = brute(x[~test], y[~test], np.ones((~test).sum()), x[test])
    got = tr.fit_predict(df, ["a", "b", "c"], local_rows=9)
    assert len(stored) == 1
    assert stored[0].agg(F.sum("many")).first()[0] == len(np.unique(np.c_[x, y], axis=0)) < 900
    rows = got.collect()
    assert len({r.rid for r in rows}) == len(rows) == test.sum()
    assert sorted((r.label, round(r.prediction, 9)) for r in rows) == sorted((a, round(b, 9)) for a, b in zip(y[test], want, strict=True))


def test_many_test_rows_of_one_node_go_to_several_tasks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (400, 2)).round(3)
    y = (x[:, 0] > 0) * 10.0 + rng.integers(0, 3, 400)
    fit = np.arange(400) < 30
    df = spark.createDataFrame([(*map(float, x[i]), float(y[i]), "train" if fit[i] else "test") for i in range(400)],
                               "a double, b double, label double, split string")
    want = brute(x[fit], y[fit], np.ones(fit.sum()), x[~fit])
    got = tr.fit_predict(df, ["a", "b"], local_rows=40).collect()  # ten parts
    assert sorted((r.label, round(r.prediction, 9)) for r in got) == sorted((a, round(b, 9)) for a, b in zip(y[~fit], want, strict=True))
