"""Registered product-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.joins import not_in
from quarry.plans import engagement as eng
from quarry.plans import profit as pro
from quarry.plans import revenue as rev
from quarry.catalog.base import query
from quarry.sources import tables as tb

BONUS_MIN = 2        # bound data: at most 4 deliveries per courier-day
SHARE_MIN = 1.5      # bound data: 36 of 64 names reach 1.5 %


# --- audience (M1-M4, M7, M9) -------------------------------------------------

@query("dau")
def q_dau(spark, sf):
    return eng.dau(tb.shop(spark, sf).user_actions)


@query("wau")
def q_wau(spark, sf):
    return eng.wau(tb.shop(spark, sf).user_actions)


@query("wau_distinct")
def q_wau_distinct(spark, sf):
    return eng.wau(tb.shop(spark, sf).user_actions, distinct=True)


@query("mau")
def q_mau(spark, sf):
    return eng.mau(tb.shop(spark, sf).user_actions)


@query("mau_distinct")
def q_mau_distinct(spark, sf):
    return eng.mau(tb.shop(spark, sf).user_actions, distinct=True)


@query("valid_orders")
def q_valid_orders(spark, sf):
    s = tb.shop(spark, sf)
    return (eng.valid_orders(s.orders, s.user_actions)
            .select("order_id", "creation_time",
                    F.size("product_ids").cast("bigint").alias("n_products")))


@query("not_in_null_guard")
def q_not_in_null_guard(spark, sf):
    """Orders whose key is blanked for urgent orders, NOT IN the cancelled
    set: the NULL keys must be dropped, as SQL NOT IN does."""
    s = tb.shop(spark, sf)
    orders = tb.table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("bigint"))
         .otherwise(F.col("o_orderkey")).alias("order_id"), "o_orderpriority")
    return not_in(orders, "order_id", eng.cancelled_order_ids(s.user_actions), "order_id")


@query("daily_users")
def q_daily_users(spark, sf):
    return eng.daily_users(tb.shop(spark, sf).user_actions)


@query("daily_paying_users")
def q_daily_paying_users(spark, sf):
    return eng.daily_paying_users(tb.shop(spark, sf).user_actions)


@query("new_users")
def q_new_users(spark, sf):
    return eng.new_users(tb.shop(spark, sf).user_actions)


@query("new_paying_users")
def q_new_paying_users(spark, sf):
    return eng.new_paying_users(tb.shop(spark, sf).user_actions)


# --- revenue (M5, M6, M8, M10-M13) ---------------------------------------------

@query("daily_revenue")
def q_daily_revenue(spark, sf):
    return rev.daily_revenue(tb.shop(spark, sf)).select(
        "date", F.col("revenue").cast("double").alias("revenue"))


@query("revenue_trend")
def q_revenue_trend(spark, sf):
    return rev.revenue_trend(tb.shop(spark, sf))


@query("arpu_daily")
def q_arpu_daily(spark, sf):
    return rev.arpu_daily(tb.shop(spark, sf))


@query("arpu_running")
def q_arpu_running(spark, sf):
    return rev.arpu_running(tb.shop(spark, sf))


@query("order_price")
def q_order_price(spark, sf):
    return rev.order_price(tb.shop(spark, sf)).select(
        "order_id", F.col("order_price").cast("double").alias("order_price"))


@query("new_user_revenue_share")
def q_new_user_revenue_share(spark, sf):
    return rev.new_user_revenue_share(tb.shop(spark, sf))


@query("product_revenue_share")
def q_product_revenue_share(spark, sf):
    return rev.product_revenue_share(tb.shop(spark, sf), min_share=SHARE_MIN)


# --- unit economics (M14-M18) ----------------------------------------------------

@query("vat")
def q_vat(spark, sf):
    sums = rev.priced_counts(tb.shop(spark, sf), ["date"],
                             {"tax": pro.vat(reduced=tb.BOUND_REDUCED_NAMES)})
    return sums.select("date", F.col("tax").cast("double").alias("tax"))


@query("orders_delivered")
def q_orders_delivered(spark, sf):
    return pro.orders_delivered(tb.shop(spark, sf))


@query("bonus_couriers")
def q_bonus_couriers(spark, sf):
    return pro.bonus_couriers(tb.shop(spark, sf), BONUS_MIN)


@query("daily_costs")
def q_daily_costs(spark, sf):
    day = pro.daily_costs(tb.shop(spark, sf), BONUS_MIN, tb.BOUND_REDUCED_NAMES)
    return day.select("date", "orders_packed", "orders_delivered", "couriers_count",
                      F.col("costs").cast("double").alias("costs"))


@query("gross_profit_report")
def q_gross_profit_report(spark, sf):
    return pro.gross_profit_report(tb.shop(spark, sf), BONUS_MIN, tb.BOUND_REDUCED_NAMES)
