"""Spearman ranks by blocks of rows against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import ranks
from quarry.plans import stats as st
from tests.test_stats import _avg_ranks


@pytest.mark.parametrize("block, per_range", [(1 << 18, 2_000_000), (16, 2_000_000), (16, 9), (1, 50)])
@pytest.mark.parametrize("gaps", ["", "b", "bd"])
def test_spearman_by_blocks(spark, monkeypatch, block, per_range, gaps):
    """Ties over blocks and ranges, a value that most rows share, infinities, both zeros, gaps in some columns."""
    monkeypatch.setattr(ranks, "BLOCK_ROWS", block)
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", per_range)
    rng = np.random.default_rng(4)
    n = 210
    x = {"a": rng.integers(0, 12, n).astype(float), "b": rng.normal(size=n), "c": np.where(rng.random(n) < 0.7, 5.0, rng.normal(size=n)),
         "d": rng.choice([0.0, -0.0, 1.0, math.inf, -math.inf], n)}
    x["b"] += x["a"] / 5
    for c in gaps:
        x[c][rng.random(n) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*x.values(), strict=True)],
                               "a double, b double, c double, d double").repartition(3)
    # the long form of all rows and columns is no longer sorted
    monkeypatch.setattr(type(df), "repartitionByRange", None)
    got = {(r.col_a, r.col_b): r.rho for r in st.spearman_matrix(df, list("abcd")).collect()}
    assert len(got) == 16
    for a in "abcd":
        for b in "abcd":
            ok = ~np.isnan(x[a]) & ~np.isnan(x[b])
            want = 1.0 if a == b else np.corrcoef(_avg_ranks(x[a][ok]), _avg_ranks(x[b][ok]))[0, 1]
            assert math.isclose(got[a, b], want, rel_tol=1e-9, abs_tol=1e-12), (a, b)


def test_spearman_of_constant_few_and_no_rows(spark):
    """A constant column ended the query with a division by zero."""
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 3.0, 1.0), (1.0, 4.0, -0.0)], "a double, b double, c double")
    got = {(r.col_a, r.col_b): r.rho for r in st.spearman_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["a", "c"] is None and got["b", "c"] == -1.0 and got["a", "a"] == 1.0
    for few in (0, 1):
        got = st.spearman_matrix(df.limit(few), ["a", "b", "c"]).collect()
        assert len(got) == 9 and sum(r.rho is not None for r in got) == 3


def test_blocks_do_not_depend_on_batches():
    """A block is found again in a second pass, however Spark cuts the rows into batches."""
    table = pa.table({"v": np.arange(100.0)})
    for step in (1, 7, 30, 100):
        found = list(ranks._blocks(iter(table.to_batches(max_chunksize=step)), 30))
        assert [t.num_rows for t in found] == [30, 30, 30, 10] and pa.concat_tables(found)["v"].to_pylist() == list(range(100))
    assert list(ranks._blocks(iter([]), 30)) == []
