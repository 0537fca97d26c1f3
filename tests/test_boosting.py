"""Boosted trees on cells against MLlib's on rows."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from quarry.plans import models as ml
from quarry.plans import trees

NAMES = ["a", "b", "c", "k"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 3000
    x = np.c_[rng.integers(0, 30, n), rng.integers(0, 7, n) ** 3, rng.integers(0, 12, n) / 7, np.full(n, 3)].astype(float)
    y = (100 * np.sin(x[:, 0] / 5) + x[:, 1] + 40 * x[:, 2] + rng.normal(0, 9, n)).astype(int)
    return spark.createDataFrame([(i, *map(float, x[i]), int(y[i]), "test" if i % 4 == 0 else "train") for i in range(n)],
                                 "id long, a double, b double, c double, k double, label int, split string").repartition(5)


def test_boosted_trees_on_cells_equal_those_on_rows(spark, data, monkeypatch):
    """The same predictions as MLlib's fit on the rows (few values, so that its sample has them all), from fewer rows."""
    rows = ml.assemble(data, NAMES)
    fit = GBTRegressor(featuresCol="features", labelCol="label", seed=ml.SEED, maxIter=15, maxDepth=3).fit(rows.where("split = 'train'"))
    want = {r.id: r.prediction for r in fit.transform(rows.where("split = 'test'")).collect()}
    fitted = []

    class Seen(GBTRegressor):
        def _fit(self, dataset):
            fitted.append((dataset.count(), dataset.agg(F.sum("rows")).first()[0]))
            return super()._fit(dataset)

    monkeypatch.setitem(ml.ESTIMATORS, "gbt", lambda **p: Seen(labelCol="label", seed=ml.SEED, **p))
    got = {r.id: r.prediction for r in ml.fit_predict(data, "gbt", NAMES, maxIter=15).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-6 * (1 + abs(want[i])) for i in want)
    assert fitted[0][0] <= 30 * 7 * 12 and fitted[0][1] == data.where("split = 'train'").count()


def test_bins_need_no_library_on_executors():
    """A broadcast is pickled by reference: it may hold arrays, no class of this package."""
    import pickletools

    bins = trees._Bins(np.zeros(2), np.ones(2), 16)
    names = [str(arg) for _, arg, _ in pickletools.genops(__import__("pickle").dumps(bins.steps))]
    assert not any("quarry" in n for n in names)
    assert (trees._Bins.of(bins.steps).place(np.array([0, 1]), np.array([0.5, 1.0])) == [8, 31]).all()


def test_passes_of_boosting_do_not_grow_with_rows(spark, data, monkeypatch):
    monkeypatch.setattr(ml, "CELLS_PER_TASK", 100)
    many = data.crossJoin(spark.range(4).select(F.col("id").alias("copy")))
    one, four = ({(r.id, round(r.prediction, 6)) for r in ml.fit_predict(d, "gbt", NAMES, maxIter=3).collect()} for d in (data, many))
    assert one == four


def test_bins_are_counted_over_all_rows(spark, monkeypatch):
    """Far values, many values, few values, one value, ends by MLlib's rule."""
    rng = np.random.default_rng(1)
    n = 4000
    far = np.r_[rng.exponential(1, n - 2), 1e12, 1e12 + 1]
    few = np.r_[rng.integers(0, 3, n - 2), 10 ** 9, 10 ** 9 + 1].astype(float)
    same = np.full(n, -2.0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.c_[far, few, same]], "far double, few double, same double").repartition(3)
    for counted in (1 << 16, 64):
        monkeypatch.setattr(trees, "COUNTED", counted)
        found = trees.bin_counts(df, ["far", "few", "same"], 32)
        assert [sum(m for _, _, m in f) for f in found] == [n, n, n]
        for f in found:
            assert all(a[1] < b[0] for a, b in zip(f, f[1:]))
        assert [(a, b) for a, b, _ in found[1]] == [(v, v) for v in (0.0, 1.0, 2.0, 1e9, 1e9 + 1)]
        cuts = ml.bin_cuts(found[0], 32)
        size = np.bincount(np.searchsorted(cuts, far), minlength=32)
        assert len(cuts) == 31 and size.max() < 1.2 * n / 32
        assert ml.bin_cuts(found[1], 32) == [0.5, 1.5, (2 + 1e9) / 2, 1e9 + 0.5] and ml.bin_cuts(found[2], 32) == []
    assert trees.bin_counts(df.limit(0), ["far"], 32) == [[]]
