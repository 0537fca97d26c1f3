"""Embedding near-duplicates against brute force."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from quarry.llm import itq
from quarry.llm.common import components

VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())),
                      StructField("label", IntegerType())])


def families(seed=0, n=600, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0 or not rows:
            v = rng.normal(size=dim)
        else:
            v = np.array(rows[int(rng.integers(0, len(rows)))][1]) + rng.normal(size=dim) * rng.choice([0.05, 0.1, 0.13, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
    return rows


def by_hand(rows):
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    return near


def test_recall_and_precision(spark):
    rows = families()
    near = by_hand(rows)
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= near.sum(axis=1)).all() and near.sum() > 100
    assert found.sum() >= 0.97 * near.sum()


def test_groups_are_split(spark, monkeypatch):
    """A bucket larger than a group gives the same counts and components."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in centre + rng.normal(size=16) * 0.01], 1) for i in range(150)]
    monkeypatch.setattr(itq, "GROUP", 20)
    got = itq.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter((r.n_links, r.component_id) for r in got) == {(149, 0): 150}
    assert sum(r.kept for r in got) == 1


def test_awkward(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0] * 3, 1),
            (8, [1.0, None, 3.0], 1), (9, [float("nan"), 2.0, 3.0], 1), (10, [float("inf"), 0.0, 0.0], 1), (11, [], 1),
            (12, [1.0, 2.0], 1), (None, v, 3), (None, v, 3), (13, [1e30, 2e30, 3e30], 1)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as cls", "'x' as vec", "2 as comp", "3 as n", "4 as grp")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(df).collect())
    assert got == Counter({(1, 4, 1, True): 1, (2, 4, 1, False): 2, (3, 4, 1, False): 1, (13, 4, 1, False): 1, (4, 0, 4, True): 1,
                           (None, 1, None, True): 2, **{(i, 0, i, True): 1 for i in (5, 6, 7, 8, 9, 10, 11, 12)}})
    assert itq.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for a in sorted(near):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = a
                todo.extend(near[x])
    got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if near[k] - {k}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
