"""Product metrics on the hand-made set; expected values from FIXTURES.md."""

from datetime import date

import pytest

from quarry.plans import engagement as eng
from quarry.plans import profit as pro
from quarry.plans import revenue as rev
from tests.conftest import rows
from tests.fixtures_shop import shop

D30, D31, O01 = date(2022, 8, 30), date(2022, 8, 31), date(2022, 10, 1)


@pytest.fixture(scope="module")
def s(spark):
    return shop(spark)


def test_dau(s):
    assert rows(eng.dau(s.user_actions)) == [(D30, 2), (D31, 2), (O01, 1)]


def test_wau_counts_actions_unless_distinct(s):
    got = dict(rows(eng.wau(s.user_actions)))
    assert got[date(2022, 8, 29)] == 5          # Monday of the week of 08-30
    assert dict(rows(eng.wau(s.user_actions, distinct=True)))[date(2022, 8, 29)] == 3


def test_revenue_trend(s):
    got = rows(rev.revenue_trend(s))
    assert got == [(D30, 350.0, 350.0, None), (D31, 220.0, 570.0, -37.14),
                   (O01, 240.0, 810.0, 9.09)]


def test_arpu_daily(s):
    got = rows(rev.arpu_daily(s))
    assert got == [(D30, 175.0, 350.0, 350.0), (D31, 110.0, 110.0, 220.0),
                   (O01, 240.0, 240.0, 240.0)]


def test_new_users(s):
    assert rows(eng.new_users(s.user_actions)) == [(D30, 2), (D31, 1)]
    assert rows(eng.new_paying_users(s.user_actions)) == [(D30, 1), (D31, 1)]


def test_arpu_running(s):
    got = rows(rev.arpu_running(s))
    assert got == [(D30, 175.0, 350.0, 350.0), (D31, 190.0, 285.0, 285.0),
                   (O01, 270.0, 405.0, 270.0)]


def test_new_user_revenue_share(s):
    got = rows(rev.new_user_revenue_share(s))
    assert got == [(D30, 350.0, 350.0, 100.0, 0.0), (D31, 220.0, 0.0, 0.0, 100.0),
                   (O01, 240.0, None, None, None)]


def test_product_revenue_share(s):
    got = {r["product_name"]: (r["revenue"], r["share_in_revenue"])
           for r in rev.product_revenue_share(s).collect()}
    assert got == {"B": (480.0, 59.26), "A": (330.0, 40.74), "ДРУГОЕ": (None, None)}


def test_tax_and_costs(s):
    day = {r["date"]: r for r in pro.daily_costs(s, min_orders=1, reduced=["A"]).collect()}
    assert [float(day[d]["tax"]) for d in (D30, D31, O01)] == [50.0, 20.0, 40.0]
    assert [day[d]["costs"] for d in (D30, D31, O01)] == [120690, 120690, None]
    day5 = {r["date"]: r["costs"] for r in pro.daily_costs(s, min_orders=5, reduced=["A"]).collect()}
    assert [day5[d] for d in (D30, D31, O01)] == [120290, 120290, None]


def test_gross_profit_report(s):
    rep = {r["date"]: r for r in pro.gross_profit_report(s, min_orders=1, reduced=["A"]).collect()}
    assert [rep[d]["gross_profit"] for d in (D30, D31, O01)] == [-120390.0, -120490.0, None]
    assert [rep[d]["total_gross_profit"] for d in (D30, D31, O01)] == [-120390.0, -240880.0, -240880.0]
    assert [rep[d]["gross_profit_ratio"] for d in (D30, D31, O01)] == [-34397.14, -54768.18, None]
    assert [rep[d]["total_gross_profit_ratio"] for d in (D30, D31, O01)] == [-34397.14, -42259.65,
                                                                             -29738.27]
    rep5 = {r["date"]: r for r in pro.gross_profit_report(s, min_orders=5, reduced=["A"]).collect()}
    assert [rep5[d]["total_gross_profit"] for d in (D30, D31, O01)] == [-119990.0, -240080.0,
                                                                        -240080.0]


def test_orders_delivered_and_bonus(s):
    assert rows(pro.orders_delivered(s)) == [(D30, 1), (D31, 1)]
    assert rows(pro.bonus_couriers(s, 1)) == [(D30, 1), (D31, 1)]
    assert rows(pro.bonus_couriers(s, 5)) == []


def test_large_product_path_gives_same_sums(s, monkeypatch):
    from quarry.plans import revenue as r
    small = {row["product_name"]: row["revenue"] for row in rev.product_revenue_share(s).collect()}
    day_small = rows(rev.daily_revenue(s))
    arpu_small = rows(rev.arpu_daily(s))
    gpr_small = rows(pro.gross_profit_report(s, min_orders=1, reduced=["A"]))
    monkeypatch.setattr(r, "BROADCAST_LIMIT_BYTES", -1)      # force the pre-aggregated path
    big = {row["product_name"]: row["revenue"] for row in rev.product_revenue_share(s).collect()}
    assert big == small and rows(rev.daily_revenue(s)) == day_small
    assert rows(rev.arpu_daily(s)) == arpu_small
    assert rows(pro.gross_profit_report(s, min_orders=1, reduced=["A"])) == gpr_small


def test_approx_distinct_users_option(s):
    assert rows(eng.dau(s.user_actions, approx=True)) == rows(eng.dau(s.user_actions))
