"""CSV with bad lines, databases, profiles, the distance from normality, running sums, label codes."""

import math
import os
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ranks
from quarry.operators.joins import Excluded, not_in
from quarry.operators.prefix import sums_before
from quarry.plans import profile as pf
from quarry.plans import stats as st
from quarry.sources import files as fs


def test_csv_with_bad_lines(spark, tmp_path):
    lines = ["id,price,day,note"] + [f"{i},{i}.5,2024-01-{i % 28 + 1:02d},n{i}" for i in range(200)]
    lines += ["x,1.5,2024-01-01,bad id", "5,6.5", "6,7.5,2024-02-30,bad day", "7,8.5,2024-01-01,a,b", ',,,', '8,9.5,2024-01-01,"q,r"']
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    df = fs.read_csv_checked(spark, str(tmp_path / "a.csv"), share=0.95)
    assert dict(df.dtypes) == {"id": "bigint", "price": "double", "day": "date", "note": "string", "bad_record": "string"}
    rows = df.collect()
    assert len(rows) == 206
    bad = {r.bad_record: r for r in rows if r.bad_record is not None}
    assert set(bad) == {"x,1.5,2024-01-01,bad id", "5,6.5", "6,7.5,2024-02-30,bad day", "7,8.5,2024-01-01,a,b"}
    assert bad["x,1.5,2024-01-01,bad id"].id is None and bad["x,1.5,2024-01-01,bad id"].price == 1.5
    assert bad["6,7.5,2024-02-30,bad day"].day is None and bad["5,6.5"].id == 5
    assert [r.note for r in rows if r.id == 8 and r.price == 9.5] == ["q,r"]


def test_types_of_few_and_no_values(spark):
    df = spark.createDataFrame([("1", None, "true", "a"), ("2", None, "false", "1")], "a string, b string, c string, d string")
    assert fs.infer_types(df) == {"a": "bigint", "b": "string", "c": "boolean", "d": "string"}


def test_database_goes_with_its_block(spark):
    name = f"d_{uuid.uuid4().hex[:8]}"
    path = fs.fresh_path(spark, name)
    with pytest.raises(ZeroDivisionError), fs.database(spark, name, path):
        t = fs.create_typed_table(spark, f"{name}.t", "a INT, b VARCHAR(3), c CHAR(2)")
        fs.append_rows(spark, t, spark.sql("select 1, 'abc', 'x'"))
        assert fs.refused(spark, t, spark.sql("select 1, 'abcd', 'x'")) and fs.refused(spark, t, spark.sql("select 1, 'a', 'xyz'"))
        assert [tuple(r) for r in spark.table(t).collect()] == [(1, "abc", "x ")]
        assert os.path.isdir(os.path.join(path, "t"))
        1 / 0
    assert not spark.catalog.databaseExists(name) and not os.path.isdir(os.path.join(path, "t"))


def test_profile_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True), (1, float("nan"), None, None), (None, 4.0, "B", True)],
                               "i int, x double, t string, b boolean")
    got = {r.column: r for r in pf.profile_columns(df).collect()}
    assert (got["i"].nulls, got["i"].distinct_values, got["i"].mean, got["i"].std) == (1, 1, 1.0, 0.0)
    assert (got["x"].nulls, got["x"].distinct_values, got["x"].mean, got["x"].max_number) == (1, 2, 3.0, 4.0)
    assert (got["t"].nulls, got["t"].min_text, got["t"].max_text, got["t"].mean) == (1, "B", "a", None)
    assert (got["b"].rows, got["b"].nulls, got["b"].distinct_values) == (3, 1, 1)
    none = {r.column: r for r in pf.profile_columns(df.limit(0)).collect()}
    assert none["x"].rows == 0 and none["x"].mean is None


@pytest.mark.parametrize("n", [1, 2, 50, 3000])
def test_kolmogorov_smirnov_equals_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(3, 2, n), 1)  # ties
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    got = st.kolmogorov_smirnov(df, "x").first()
    assert got.n == n
    if n < 2:
        assert got.d is None and got.p is None
        return
    s = np.sort(x)
    f = np.array([0.5 * math.erfc(-(v - s.mean()) / s.std(ddof=1) / math.sqrt(2)) for v in s])
    i = np.arange(1, n + 1)
    # at a tie the step is taken whole
    d = max(np.max(np.searchsorted(s, s, "right") / n - f), np.max(f - np.searchsorted(s, s, "left") / n))
    assert math.isclose(got.d, d, rel_tol=1e-9) and 0 <= got.p <= 1 and len(i) == n
    same = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert st.kolmogorov_smirnov(same, "x").first().d is None


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"g{i % 7}", int(k), int(rng.integers(1, 9))) for i, k in enumerate(rng.permutation(600))]
    got = sums_before(spark.createDataFrame(rows, "g string, k int, w int").repartition(6), ["g"], ["k"], ["w"]).collect()
    assert len(got) == 600
    for r in got:
        assert r.before_w == sum(w for g, k, w in rows if g == r.g and k < r.k)
        assert r.all_w == sum(w for g, _, w in rows if g == r.g)


@pytest.mark.parametrize("few", [10_000, 3])
def test_label_codes_of_any_number(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW_CLASSES", few)
    values = ["b", "a", None, "ü", "", "B", "a", "zz"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.code for r in ranks.dense_codes(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=str.encode))}
    flags = {r.v: r.code for r in ranks.dense_codes(spark.createDataFrame([(True,), (False,), (True,)], "v boolean"), "v").collect()}
    assert flags == {False: 0, True: 1}


@pytest.mark.parametrize("ids", [[], [2], [2, None], [2, 2, 5]])
def test_shared_exclusion_equals_not_in(spark, ids):
    left = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 5, None)], "k long")
    right = spark.createDataFrame([(i,) for i in ids], "x long")
    want = Counter(r.k for r in not_in(left, "k", right, "x").collect())
    shared = Excluded(right, "x")
    assert Counter(r.k for r in shared.without(left, "k").collect()) == want
    assert Counter(r.k for r in shared.flag(left, "k", "ok").collect() if r.ok) == want
    assert shared.flag(left, "k", "ok").count() == 6
