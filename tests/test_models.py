"""Nearest neighbours against brute force; model plumbing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.neighbours import neighbours
from quarry.plans import models as ml


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n, d = 300, 4
    x = rng.integers(0, 4, (n, d)).astype(float)          # many exact distance ties
    y = rng.integers(0, 3, n).astype(float)
    rows = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label double")
    return ml.hash_split(df, "id"), x, y


def _brute(x, y, train, test, k):
    out = {}
    for q in test:
        d = ((x[train] - x[q]) ** 2).sum(1)
        order = np.lexsort((train, d))[:k]
        out[q] = [int(train[i]) for i in order]
    return out


@pytest.mark.parametrize("block_rows,pivots", [(1000, None), (37, 5), (20, 60), (1000, 1)])
def test_neighbours_exact_with_ties(spark, data, block_rows, pivots):
    df, x, y = data
    split = {r["id"]: r["split"] for r in df.collect()}
    train = np.array(sorted(i for i, s in split.items() if s == "train"))
    test = np.array(sorted(i for i, s in split.items() if s == "test"))
    nbs = neighbours(df.where(F.col("split") == "train"), df.where(F.col("split") == "test"), 5,
                     block_rows=block_rows, pivots=pivots)
    got = {}
    for r in nbs.orderBy("qid", "nb_rank").collect():
        got.setdefault(r["qid"], []).append(r["tid"])
    assert got == _brute(x, y, train, test, 5)
    votes = {r["qid"]: r["predicted"] for r in ml.vote(nbs, 5).collect()}
    q = int(test[0])
    labs = [y[t] for t in got[q]]
    counts = {v: labs.count(v) for v in set(labs)}
    best = max(counts.values())
    assert votes[q] == min(v for v, c in counts.items() if c == best)


def clustered(spark, n, seed):
    """Rows around as many centres as the square root of their number."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 100, (int(n ** 0.5), 6))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(0, 1, (n, 6))
    return x, spark.createDataFrame([(i, [float(v) for v in x[i]], float(i % 3)) for i in range(n)],
                                    "id long, vec array<double>, label double")


def test_pairs_grow_slower_than_train_times_test(spark):
    share = []
    for n in (1000, 4000):
        x, df = clustered(spark, n, 4)
        report = {}
        nbs = neighbours(df.where("id % 4 > 0"), df.where("id % 4 = 0"), 3, report=report).collect()
        ids = np.arange(n)
        want = _brute(x, None, ids[ids % 4 > 0], ids[ids % 4 == 0], 3)
        got = {}
        for r in sorted(nbs, key=lambda r: r["nb_rank"]):
            got.setdefault(r["qid"], []).append(r["tid"])
        assert got == want
        share.append(report["pairs"] / (report["train"] * report["test"]))
    assert share[0] < 0.25 and share[1] < 0.6 * share[0]


def test_pruned_search_is_exact_on_far_and_equal_rows(spark):
    rng = np.random.default_rng(9)
    x = np.r_[np.full((200, 3), 7.0), rng.normal(0, 1e6, (100, 3)), rng.normal(0, 1e-6, (100, 3)), np.zeros((50, 3))]
    rows = [(i, [float(v) for v in x[i]], float(i % 5)) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label double")
    got = {}
    for r in neighbours(df, df, 4, block_rows=64).orderBy("qid", "nb_rank").collect():
        got.setdefault(r["qid"], []).append(r["tid"])
    ids = np.arange(len(x))
    assert got == _brute(x, None, ids, ids, 4)


def test_queries_are_rows(spark):
    """Ids may repeat on both sides; every query row has its own neighbours."""
    train = spark.createDataFrame([(1, [0.0], 5.0), (1, [0.0], 3.0), (2, [9.0], 7.0)], "id long, vec array<double>, label double")
    test = spark.createDataFrame([(4, [0.0], 1.0), (4, [0.0], 1.0), (4, [8.0], 2.0)], "id long, vec array<double>, truth double")
    rows = neighbours(train, test, 2).collect()
    assert sorted((r["tid"], r["label"], r["nb_rank"]) for r in rows) == sorted(
        [(1, 3.0, 1), (1, 5.0, 2)] * 2 + [(2, 7.0, 1), (1, 3.0, 2)])
    means = sorted((r["prediction"], r["label"]) for r in ml.knn_mean(neighbours(train, test, 2), 2).collect())
    assert means == [(4.0, 1.0), (4.0, 1.0), (5.0, 2.0)]
    assert neighbours(train.limit(0), test, 2).count() == 0 and neighbours(train, test.limit(0), 2).count() == 0
    assert neighbours(train, test, 9).count() == 9  # fewer rows than k


def test_hash_split_is_about_70_percent(data):
    df, _, _ = data
    frac = df.where(F.col("split") == "train").count() / df.count()
    assert 0.6 < frac < 0.8


def test_regressors_learn_linear_target(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        a, b = (float(v) for v in rng.uniform(1, 10, 2))
        rows.append((i, a, b, a * b, a * a, b * b, a + b, int(10 * a * b)))
    df = spark.createDataFrame(rows, "item_id long, depth double, height double, width double, "
                                     "s1 double, s2 double, s3 double, label int")
    split = ml.hash_split(df, "item_id")
    lin = ml.metrics(ml.fit_predict(split, "linear"), "linear").first()
    assert lin["r2"] > 0.99
    tree = ml.metrics(ml.fit_predict(split, "tree"), "tree").first()
    assert tree["r2"] > 0.8
    rff = ml.metrics(ml.kernel_predict(split), "kernel_rff").first()
    assert rff["r2"] > 0.8


def test_equal_distances_are_taken_in_bounded_runs():
    """Rows that all lie as far from every query were candidates at once, with all their components."""
    import tracemalloc

    import pyarrow as pa

    from quarry.operators import neighbours as nb

    n, m, d = 3000, 1500, 32
    t = np.zeros((n, d))
    t[np.arange(n), np.arange(n) % d] = 1.0
    q = np.zeros((m, d))
    train = pa.table({"t_id": np.arange(n)[::-1].copy(), "t_vec": list(t), "t_label": np.zeros(n)})
    test = pa.table({"q_id": np.arange(m), "q_row": np.arange(m), "q_truth": np.zeros(m), "q_vec": list(q)})
    tracemalloc.start()
    try:
        got = nb._best(3)((), test, train)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got["tid"].to_pylist() == [0, 1, 2] * m and set(got["dist"].to_pylist()) == {1.0}
    assert peak < 300 << 20  # 1500 * 3000 candidates of 32 doubles are 1,150 MB


@pytest.mark.parametrize("pivots", [None, 3, 90])
def test_copies_in_few_and_many_dimensions(spark, pivots):
    """Many copies of few vectors: the first ids of a vector are its neighbours, work does not grow with copies."""
    rng = np.random.default_rng(2)
    for d in (3, 12):
        kinds = rng.integers(0, 50, (40, d)).astype(float)
        x = kinds[np.r_[np.zeros(500, int), rng.integers(0, 40, 300)]]
        df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(i % 3)) for i in range(len(x))],
                                   "id long, vec array<double>, label double")
        report = {}
        got = {}
        for r in neighbours(df.where("id % 4 > 0"), df.where("id % 4 = 0"), 3, block_rows=50, pivots=pivots,
                            report=report).orderBy("qrow", "nb_rank").collect():
            got.setdefault(r["qid"], []).append(r["tid"])
        ids = np.arange(len(x))
        assert got == _brute(x, None, ids[ids % 4 > 0], ids[ids % 4 == 0], 3)
        assert report["train"] <= 3 * 40


def test_kernel_model_equals_mllib_ridge_without_its_passes(spark, monkeypatch):
    """The same model as MLlib's ridge on the same features, in three jobs over the rows and no MLlib fit."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(6)
    x = np.c_[rng.normal(5, 2, (400, 3)), np.full(400, 3.0)]  # one constant feature
    y = (np.sin(x[:, 0]) * 40 + x[:, 1] ** 2 + 1000 + rng.normal(0, 2, 400)).astype(int)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i]), "test" if i % 4 == 0 else "train") for i in range(400)],
                               "id long, a double, b double, c double, k double, label int, split string")
    names = ["a", "b", "c", "k"]
    rff, cols = ml.fourier_features(df, names, 40)
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(rff)
    fit = LinearRegression(featuresCol="features", labelCol="label", regParam=1e-3, elasticNetParam=0.0, solver="normal").fit(
        data.where("split = 'train'"))
    want = {r.id: r.prediction for r in fit.transform(data.where("split = 'test'")).collect()}
    monkeypatch.setattr(ml, "LinearRegression", None)
    got = {r.id: r.prediction for r in ml.kernel_predict(df, names).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * abs(want[i]) for i in want)
    assert ml.kernel_predict(df.where("split = 'test'"), names).where("prediction is not null").count() == 0


def test_a_checkpoint_is_not_written_again(spark):
    """Models that are fitted on one split store it once."""
    from quarry.session import cut_lineage

    one = cut_lineage(spark.range(10).withColumn("v", F.col("id") * 2))
    assert cut_lineage(one) is one
    other = cut_lineage(one.where("id > 3"))
    assert other is not one and sorted(r.v for r in other.collect()) == [8, 10, 12, 14, 16, 18] and one.count() == 10
