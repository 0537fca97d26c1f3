"""Catalogue cleaning and profiling on hand-made rows (FIXTURES.md section 3)."""

import math

import numpy as np
import pytest

from quarry.plans import charts as ch
from quarry.plans import clean as cl
from quarry.plans import profile as pf
from tests.conftest import rows

ITEMS = "item_id int, category string, price double, old_price string, other_colors string, " \
        "depth double, height double, width double"
ROWS = [
    (1, "Beds", 100.0, "No old price", "No", 10.0, 20.0, None),
    (2, "Beds", 200.0, "SR 1,345", "Yes", None, 30.0, None),
    (3, "Beds", 300.0, "SR 130/4 pack", "No", 30.0, None, None),
    (4, "Chairs", 50.0, "SR 60", "Yes", 5.0, 6.0, 7.0),
    (5, "Chairs", 50.0, "No old price", "No", 7.0, 8.0, 9.0),
    (6, "Chairs", 70.0, "SR 70", "Yes", None, 10.0, 11.0),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ROWS, ITEMS)


def test_clean_old_price(items):
    got = dict(rows(cl.clean_old_price(items).select("item_id", "old_price")))
    assert got == {1: 100.0, 2: 1345.0, 3: 0.0, 4: 60.0, 5: 50.0, 6: 70.0}
    d = dict(rows(cl.discounts(cl.clean_old_price(items)).select("item_id", "discount")))
    assert d[3] == -300.0 and d[2] == 1145.0
    assert dict(rows(cl.clean_old_price(items, unparsed="null").select("item_id", "old_price")))[3] is None


def test_impute_group_median_all_null_group_stays_null(items):
    got = {r["item_id"]: (r["depth"], r["height"], r["width"])
           for r in cl.impute_group_median(items, "category", ["depth", "height", "width"]).collect()}
    assert got[2] == (20.0, 30.0, None)        # Beds: depth median of 10, 30; width all NULL
    assert got[3] == (30.0, 25.0, None)
    assert got[6] == (6.0, 10.0, 11.0)         # Chairs depth median of 5, 7


def test_label_encode_sorted_from_zero(items):
    enc = cl.label_encode(items, {"category": "cat", "other_colors": "col"})
    assert set(rows(enc.select("category", "cat"))) == {("Beds", 0), ("Chairs", 1)}
    assert set(rows(enc.select("other_colors", "col"))) == {("No", 0), ("Yes", 1)}


def test_geometry(items):
    g = {r["item_id"]: r for r in cl.add_geometry(items).collect()}
    assert g[4]["v_furniture"] == 5.0 * 6.0 * 7.0 / 1e6 and g[4]["s1"] == 30.0
    assert g[1]["v_furniture"] is None


def test_map_codes_and_bikes(spark):
    df = spark.createDataFrame([(0.0, 1.0), (3.0, 26.0), (5.0, 11.0), (None, None)],
                               "season double, weather_code double")
    got = rows(df.select(cl.map_codes("season", cl.SEASONS).alias("s"),
                         cl.map_codes("weather_code", cl.WEATHER).alias("w")))
    assert got == [("spring", "Clear"), ("winter", "Snowfall"), (None, None), (None, None)]
    bikes = spark.createDataFrame([("2015-01-04 00:00:00", 182, 3.0, 2.0, 93.0, 6.0, 3.0, 0.0, 1.0, 3.0)],
                                  "timestamp string, cnt int, t1 double, t2 double, hum double, "
                                  "wind_speed double, weather_code double, is_holiday double, "
                                  "is_weekend double, season double")
    out = cl.clean_bikes(bikes).first()
    assert out["humidity_percent"] == 0.93 and out["season"] == "winter"
    assert out["weather"] == "Broken clouds" and out["count"] == 182


def test_profile_parts(items):
    assert rows(pf.shape(items)) == [(6, 8)]
    assert dict(rows(pf.info(items).select("column", "non_null")))["width"] == 3
    d = {r["column"]: r for r in pf.describe(items, ["price"]).collect()}["price"]
    assert d["count"] == 6 and d["min"] == 50.0 and d["max"] == 300.0
    assert d["p25"] == 55.0 and d["p50"] == 85.0 and d["p75"] == 175.0   # numpy linear quantiles
    assert math.isclose(d["std"], float(np.std([100, 200, 300, 50, 50, 70], ddof=1)), rel_tol=1e-12)
    assert rows(pf.value_counts(items, "category")) == [("Beds", 3), ("Chairs", 3)]


def test_group_stats_and_extremes(items):
    s = {r["category"]: r for r in ch.group_stats(items, "category", "price").collect()}
    assert s["Chairs"]["mean_price"] == 56.7 and s["Beds"]["total_price"] == 600.0
    ext = rows(ch.extreme_groups(items, "category", "price"))
    assert ext == [("Beds", 200.0, True), ("Chairs", 56.666666666666664, False)]
    sh = dict((r["other_colors"], r["percent"]) for r in ch.shares(items, "other_colors").collect())
    assert sh == {"No": 50.0, "Yes": 50.0}


def test_label_codes_of_every_type(spark):
    from quarry.operators import ranks
    for kind, values in (("string", "format_string('c%03d', id)"), ("bigint", "id + 1152921504606846976"), ("date", "date_add(date '2020-01-01', int(id))"),
                         ("boolean", "id % 2 = 1"), ("decimal(20,3)", "cast(id / 8 as decimal(20,3))")):
        df = spark.range(50).union(spark.range(50)).selectExpr(f"cast({values} as {kind}) as c")
        got = dict(rows(ranks.dense_codes(df, "c", "code")))
        want = sorted({r[0] for r in df.collect()})
        assert got == {v: i for i, v in enumerate(want)}, kind


def test_describe_approx_close_to_exact(items):
    exact = {r["column"]: r for r in pf.describe(items, ["price", "height"]).collect()}
    approx = {r["column"]: r for r in pf.describe(items, ["price", "height"], approx=True).collect()}
    for c in ("price", "height"):
        assert approx[c]["count"] == exact[c]["count"] and approx[c]["max"] == exact[c]["max"]
        assert exact[c]["min"] <= approx[c]["p50"] <= exact[c]["max"]
