"""Null-aware NOT IN semantics of the anti join."""

from quarry.operators.joins import not_in
from tests.conftest import rows

L = "k bigint, v string"
R = "k bigint"


def test_plain(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], L)
    right = spark.createDataFrame([(2,), (2,)], R)
    assert rows(not_in(left, "k", right, "k")) == [(1, "a")]


def test_null_in_right_removes_everything(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], L)
    right = spark.createDataFrame([(2,), (None,)], R)
    assert rows(not_in(left, "k", right, "k")) == []


def test_empty_right_keeps_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "c")], L)
    right = spark.createDataFrame([], R)
    assert rows(not_in(left, "k", right, "k"), "v") == [("a",), ("c",)]


def test_matches_spark_sql_not_in(spark):
    left = spark.createDataFrame([(i if i % 5 else None, str(i)) for i in range(50)], L)
    right = spark.createDataFrame([(i,) for i in range(0, 50, 3)], R)
    left.createOrReplaceTempView("l_t")
    right.createOrReplaceTempView("r_t")
    want = rows(spark.sql("SELECT * FROM l_t WHERE k NOT IN (SELECT k FROM r_t)"))
    assert rows(not_in(left, "k", right, "k")) == want
