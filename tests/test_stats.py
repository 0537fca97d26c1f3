"""Order statistics and tests against small numpy references."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.normal import norm_ppf
from quarry.operators import ranks
from quarry.plans import stats as st


def _ref_swilk(x):
    """Plain numpy version of Royston's Shapiro-Wilk (n >= 12)."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    nd = statistics.NormalDist()
    m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    S = float(m @ m)
    r = 1 / math.sqrt(n)
    c1 = [0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
    c2 = [0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
    an = m[-1] / math.sqrt(S) + sum(c * r ** i for i, c in enumerate(c1))
    an1 = m[-2] / math.sqrt(S) + sum(c * r ** i for i, c in enumerate(c2))
    phi = (S - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
    w = (a @ x) ** 2 / ((x - x.mean()) @ (x - x.mean()))
    ln = math.log(n)
    mu = -1.5861 - 0.31082 * ln - 0.083751 * ln ** 2 + 0.0038915 * ln ** 3
    sg = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln ** 2)
    z = (math.log(1 - w) - mu) / sg
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def test_norm_ppf_matches_python(spark):
    ps = [1e-12, 1e-5, 0.01, 0.2, 0.425, 0.5, 0.7, 0.93, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(norm_ppf("p")).collect()]
    for p, g in zip(ps, got):
        assert math.isclose(g, statistics.NormalDist().inv_cdf(p), rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 300)])
def test_shapiro_wilk_matches_reference(spark, seed, n):
    rng = np.random.default_rng(seed)
    x = np.round(rng.lognormal(size=n), 2)            # ties after rounding
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = st.shapiro_wilk(df, "x").first()
    w, p = _ref_swilk(x)
    assert r["n"] == n
    assert math.isclose(r["w"], w, rel_tol=1e-9)
    assert math.isclose(r["p"], p, rel_tol=1e-6)


def test_mann_whitney_matches_pairwise_count(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 20, 60).astype(float)
    b = rng.integers(3, 25, 45).astype(float)
    df = spark.createDataFrame([(float(v), "No") for v in a] + [(float(v), "Yes") for v in b],
                               "price double, other_colors string")
    r = st.mann_whitney_u(df, "price", "other_colors", "No", "Yes").first()
    u1 = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r["u1"] == u1 and r["u2"] == len(a) * len(b) - u1
    allv = np.concatenate([a, b])
    _, t = np.unique(allv, return_counts=True)
    n1, n2, nn = len(a), len(b), len(allv)
    sigma = math.sqrt(n1 * n2 / 12 * ((nn + 1) - (t ** 3 - t).sum() / (nn * (nn - 1))))
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sigma
    assert math.isclose(r["z"], z, rel_tol=1e-12)
    p = st.two_sided_p(st.mann_whitney_u(df, "price", "other_colors", "No", "Yes")).first()["p"]
    assert math.isclose(p, min(1.0, math.erfc(z / math.sqrt(2))), rel_tol=1e-12)


def _avg_ranks(v):
    order = np.argsort(v, kind="mergesort")
    r = np.empty(len(v))
    r[order] = np.arange(1, len(v) + 1)
    for val in np.unique(v):
        idx = v == val
        r[idx] = r[idx].mean()
    return r


def test_spearman_pairwise_complete(spark):
    rng = np.random.default_rng(3)
    n = 80
    a = rng.integers(0, 10, n).astype(float)
    b = a * 2 + rng.integers(0, 5, n)
    c = rng.normal(size=n)
    c[::7] = np.nan                                       # gaps -> pairwise rows
    df = spark.createDataFrame([(float(x), float(y), None if np.isnan(z) else float(z))
                                for x, y, z in zip(a, b, c)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["rho"] for r in st.spearman_matrix(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got[("a", "a")] == 1.0
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        cols = {"a": a, "b": b, "c": c}
        mask = ~np.isnan(cols[x]) & ~np.isnan(cols[y])
        want = np.corrcoef(_avg_ranks(cols[x][mask]), _avg_ranks(cols[y][mask]))[0, 1]
        assert math.isclose(got[(x, y)], want, rel_tol=1e-9)
        assert got[(y, x)] == got[(x, y)]
    complete = df.na.drop()
    fast = {(r["col_a"], r["col_b"]): r["rho"] for r in st.spearman_matrix(complete, ["a", "b", "c"]).collect()}
    slow = {(r["col_a"], r["col_b"]): r["rho"]
            for r in st.spearman_matrix(complete, ["a", "b", "c"], complete=False).collect()}
    for k, v in fast.items():
        assert math.isclose(v, slow[k], rel_tol=1e-9)


@pytest.mark.parametrize("direct", [10 ** 6, 40, 0])
def test_quantiles_grouped_with_hot_value(spark, direct):
    rng = np.random.default_rng(11)
    vals = np.concatenate([np.full(300, 5.0), rng.normal(5, 2, 600).round(1)])
    groups = np.array(["g1", "g2"])[rng.integers(0, 2, len(vals))]
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, vals)], "g string, v double")
    got = {(r["g"], r["q"]): r["value"] for r in ranks.quantiles(df, "v", [0, 0.1, 0.25, 0.5, 0.9, 1.0],
                                                                  by=["g"], direct=direct).collect()}
    for g in ("g1", "g2"):
        for q in (0, 0.1, 0.25, 0.5, 0.9, 1.0):
            assert math.isclose(got[(g, q)], float(np.quantile(vals[groups == g], q)), rel_tol=1e-12)


def test_average_ranks_match_numpy(spark):
    v = np.array([3.0, 1.0, 3.0, 2.0, 3.0, 5.0, 1.0])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = {r["x"]: r["rank"] for r in ranks.average_ranks(ranks.value_positions(df, "v", buckets=3)).collect()}
    want = dict(zip(v, _avg_ranks(v)))
    assert got == want


def test_pearson(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (4.0, 8.3)], "x double, y double")
    r = st.pearson(df, "x", "y").first()
    assert r["n"] == 3 and math.isclose(r["r"], np.corrcoef([1, 2, 4], [2, 4.1, 8.3])[0, 1], rel_tol=1e-12)


def test_decision(spark):
    df = spark.createDataFrame([(0.2, 0.001)], "w double, p double")
    assert st.decide(df, "t", 0.01, "w").first()["reject"] is True


def test_quantiles_binary_search_buckets(spark):
    rng = np.random.default_rng(13)
    vals = np.concatenate([np.full(5000, 2.5), rng.normal(0, 3, 20000).round(4)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    bounds = ranks._boundaries(df, "v", 300)
    assert len(bounds) > ranks.CASE_LIMIT          # exercises the searchsorted path
    report = {}
    got = {r["q"]: r["value"] for r in ranks.quantiles(df, "v", [0.01, 0.3, 0.5, 0.99], direct=50, report=report).collect()}
    assert len(report["left"]) <= 5
    for q, v in got.items():
        assert math.isclose(v, float(np.quantile(vals, q)), rel_tol=1e-12, abs_tol=1e-12)
    b = df.select(ranks.bucket_of(F.col("v"), bounds).alias("b"), "v").collect()
    edges = np.asarray(bounds)
    assert all(r["b"] == int(np.searchsorted(edges, r["v"])) for r in b[:2000])


@pytest.mark.parametrize("direct", [10 ** 6, 0])
def test_quantiles_of_awkward_values(spark, direct):
    inf = float("inf")
    sets = {"wide": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0, 1e300], "infinite": [-inf, inf, 0.0, 1.0, 2.0, inf],
            "zeros": [0.0, -0.0, 0.0, 1.0], "one": [4.0], "close": [1.0 + i * 2.0 ** -52 for i in range(60)], None: [2.0, 8.0]}
    rows = [(g, v) for g, vs in sets.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["q"]): r["value"] for r in ranks.quantiles(df, "v", [0.0, 0.5, 1.0], by=["g"], direct=direct).collect()}
    assert {g for g, _ in got} == set(sets)
    for g, vs in sets.items():
        vs = sorted(vs)
        assert (got[g, 0.0], got[g, 1.0]) == (vs[0], vs[-1])
        k = (len(vs) - 1) / 2
        lo, hi = vs[math.floor(k)], vs[math.ceil(k)]
        assert got[g, 0.5] == (lo if lo == hi else lo + (hi - lo) * 0.5)
    assert ranks.quantiles(df.where("g = 'none'"), "v", [0.5], by=["g"], direct=direct).count() == 0


@pytest.mark.parametrize("rows_per_range", [2_000_000, 7])
def test_ranks_in_place(spark, monkeypatch, rows_per_range):
    """Ties that span ranges, keys that share a range."""
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", rows_per_range)
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 4, 300)
    values = np.where(rng.random(300) < 0.4, 5.0, rng.integers(0, 9, 300).astype(float))
    values[keys == 3] = 1.0  # a key of one value
    df = spark.createDataFrame([(int(k), float(v), i) for i, (k, v) in enumerate(zip(keys, values))], "k int, v double, i long")
    got = {r["row"]: r["rank"] for r in ranks.ranks_in_place(df.repartition(5), "k", "v", "i", 300).collect()}
    for k in range(4):
        at = np.flatnonzero(keys == k)
        assert [got[i] for i in at] == list(_avg_ranks(values[at]))
    assert ranks.ranks_in_place(df.limit(0), "k", "v", "i", 0).count() == 0


def test_spearman_plan_has_two_shuffles(spark):
    df = spark.createDataFrame([(float(i), float(i % 5), float(-i)) for i in range(50)], "a double, b double, c double")
    got = st.spearman_matrix(df, ["a", "b", "c"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(row") == 1 and "Join" not in plan
