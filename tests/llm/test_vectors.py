"""Product codes: the search against all distances, the codebooks against plain Python, awkward vectors."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from quarry.llm import vectors
from quarry.llm.catalog import QUERIES
from tests.conftest import SF001


def schema(kind=FloatType()):
    return StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(kind)),
                       StructField("label", IntegerType())])


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 6), st.integers(1, 20), st.integers(1, 30), st.sampled_from([1, 3, 1000, 1 << 27]), st.integers(0, 10 ** 6))
def test_search_equals_all_distances(d, k, n, span, seed):
    rng = np.random.default_rng(seed)
    book, parts = rng.integers(-span, span + 1, (k, d)), rng.integers(-span, span + 1, (n, d))
    index, dist, _ = vectors.nearest(parts, book)
    every = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()


def test_search_leaves_entries_out():
    rng = np.random.default_rng(5)
    book = rng.normal(0, 1000, (64, 4)).astype(np.int64) + np.linspace(-9000, 9000, 64).astype(np.int64)[:, None]
    _, _, compared = vectors.nearest(book[rng.integers(0, 64, 5000)] + rng.integers(-50, 50, (5000, 4)), book)
    assert compared < 5000 * 64 / 4


def by_hand(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1]) // parts
    cut = [[v[p * d:(p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0], kept[r][1]))[:entries]
    books = [[list(cut[r][p]) for r in first] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for row in cut:
                groups[near(p, row[p])[1]].append(row[p])
            for k, held in groups.items():
                books[p][k] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    found = [[near(p, row[p]) for p in range(parts)] for row in cut]
    per = Counter()
    for (_, _, lab), f in zip(kept, found, strict=True):
        per[lab] += sum(x for x, _ in f)
    out = Counter((i, "".join(f"{k:02x}" for _, k in f), sum(x for x, _ in f), per[lab])
                  for (i, _, lab), f in zip(kept, found, strict=True))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def check(spark, rows, kind=FloatType(), extra=()):
    df = spark.createDataFrame(rows, schema(kind))
    for c in extra:
        df = df.withColumn(c, F.lit(3))
    codes, books = vectors.compress(df.repartition(3))
    got = Counter((r.vec_id, r.code.hex(), r.error, r.label_error) for r in vectors.with_label_error(codes).collect())
    given_back = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert (got, vectors.books_digest(books)) == by_hand(given_back)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16)], i % 3 or None) for i in range(60)]
    rows += [(100, None, 1), (101, [0.5] * 15 + [None], 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] + [0.0] * 15, 1),
             (104, [0.0] * 16, None), (5, [0.25] * 16, 2), (5, [0.25] * 16, 2), (None, [-0.3] * 16, 2), (-9, [1e-9, -1e-9] * 8, 1)]
    check(spark, rows, extra=("ints", "code", "error", "part", "entry", "n", "total", "__label", "none", "value"))


def test_few_and_equal_vectors(spark):
    check(spark, [(i, [0.1 * i] * 8, 1) for i in range(5)], DoubleType())
    check(spark, [(i, [0.5] * 8, 1) for i in range(40)])


def test_lengths_that_do_not_fit(spark):
    rows = [(1, [0.5] * 8, 1), (2, [0.25] * 8, 1), (3, [0.5] * 9, 1), (4, [0.5] * 16, 1), (5, [], 1)]
    codes, _ = vectors.compress(spark.createDataFrame(rows, schema()))
    assert sorted(r.vec_id for r in codes.collect()) == [1, 2]
    with pytest.raises(Exception, match="2 \\*\\* 27"):
        vectors.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], schema()))


def test_empty_table(spark, tmp_path):
    codes, books = vectors.compress(spark.createDataFrame([], schema()))
    assert books is None and vectors.with_label_error(codes).count() == 0
    spark.createDataFrame([(1, None, 1)], schema()).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["op11_codes"](spark, str(tmp_path)).count() == 0


def test_whole_table_by_hand(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    check(spark, rows[:200])
