"""CSV round trip, export with row index, head/tail."""

from pyspark.sql import functions as F

from quarry.sources import files as fs
from quarry.sources import tables as tb
from tests.conftest import SF001, rows


def test_row_index_matches_row_number(spark):
    lines = tb.table(spark, SF001, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                      "l_suppkey").repartition(5)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    got = fs.with_row_index(lines, keys)
    from pyspark.sql import Window
    want = lines.select((F.row_number().over(Window.orderBy(*keys)) - 1).alias("index"), *keys)
    assert rows(got) == rows(want)


def test_csv_roundtrip_and_export(spark):
    nation = tb.table(spark, SF001, "nation")
    path = fs.export(nation, fs.fresh_path(spark, "nation"), fmt="csv", index_by=["n_nationkey"],
                     single_file=True)
    back = fs.read_csv(spark, path, "index long, n_nationkey int, n_name string, n_regionkey int")
    assert back.count() == 25
    assert rows(back.select("index", "n_nationkey")) == [(i, i) for i in range(25)]


def test_head_tail(spark):
    orders = tb.table(spark, SF001, "orders")
    keys = [r["o_orderkey"] for r in orders.select("o_orderkey").collect()]
    assert [r["o_orderkey"] for r in fs.head(orders, ["o_orderkey"], 3).collect()] == sorted(keys)[:3]
    assert [r["o_orderkey"] for r in fs.tail(orders, ["o_orderkey"], 3).collect()] == sorted(keys)[-3:]
