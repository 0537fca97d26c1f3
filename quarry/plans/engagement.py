"""Audience metrics over ``user_actions`` (M1-M4, M7, M9).

Every job aggregates raw actions down to one row per day/week/month before
anything else happens, so the only wide shuffles are the partial->final
aggregation exchanges (count-distinct adds one on (day, user)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import not_in

CANCEL = "cancel_order"


def action_date(col: str = "time"):
    return F.to_date(F.col(col))


def cancelled_order_ids(actions: DataFrame) -> DataFrame:
    """The ids of cancelled orders (may repeat; callers only anti-join)."""
    return actions.where(F.col("action") == CANCEL).select("order_id")


def valid_orders(orders: DataFrame, actions: DataFrame) -> DataFrame:
    """M4: orders whose id is NOT IN the cancelled set (null-aware)."""
    return not_in(orders, "order_id", cancelled_order_ids(actions), "order_id")


def valid_actions(actions: DataFrame) -> DataFrame:
    """User actions that belong to a non-cancelled order."""
    return not_in(actions, "order_id", cancelled_order_ids(actions), "order_id")


def distinct_users(approx: bool = False, rsd: float = 0.01):
    """Exact distinct count, or opt-in HyperLogLog++ (``approx=True``, relative
    standard deviation ``rsd``) - one fixed-size sketch per group instead of
    the exact count's (group, user) shuffle."""
    return F.approx_count_distinct("user_id", rsd) if approx else F.countDistinct("user_id")


def dau(actions: DataFrame, approx: bool = False) -> DataFrame:
    """M1: distinct users per day, cancellations included."""
    return (actions.groupBy(action_date().alias("dt"))
            .agg(distinct_users(approx).alias("dau")))


def _period_users(actions: DataFrame, unit: str, name: str, distinct: bool,
                  approx: bool = False) -> DataFrame:
    period = F.date_trunc(unit, F.col("time")).cast("date").alias(unit)
    measure = distinct_users(approx) if distinct else F.count("user_id")
    return actions.groupBy(period).agg(measure.alias(name))


def wau(actions: DataFrame, distinct: bool = False, approx: bool = False) -> DataFrame:
    """M2: per ISO week (Monday start). As in the original the default counts
    actions (``COUNT(user_id)``); ``distinct=True`` gives true weekly users."""
    return _period_users(actions, "week", "wau", distinct, approx)


def mau(actions: DataFrame, distinct: bool = False, approx: bool = False) -> DataFrame:
    """M3: per calendar month, same convention as :func:`wau`."""
    return _period_users(actions, "month", "mau", distinct, approx)


def daily_users(actions: DataFrame, approx: bool = False) -> DataFrame:
    """M7: distinct users with any action per day."""
    return (actions.groupBy(action_date().alias("date"))
            .agg(distinct_users(approx).alias("users")))


def daily_paying_users(actions: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """M7: distinct users with an action on a non-cancelled order per day
    (``valid``: those actions, when the caller already has them)."""
    valid = valid if valid is not None else valid_actions(actions)
    return (valid.groupBy(action_date().alias("date"))
            .agg(F.countDistinct("user_id").alias("paying_users")))


def first_dates(actions: DataFrame, name: str = "date") -> DataFrame:
    """Each user's first action date (one row per user)."""
    return actions.groupBy("user_id").agg(F.min(action_date()).alias(name))


def new_users(actions: DataFrame) -> DataFrame:
    """M9: users whose first action falls on the day."""
    return (first_dates(actions).groupBy("date")
            .agg(F.count("user_id").alias("new_users")))


def new_paying_users(actions: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """M9: users whose first action on a valid order falls on the day."""
    valid = valid if valid is not None else valid_actions(actions)
    return (first_dates(valid).groupBy("date")
            .agg(F.count("user_id").alias("new_paying_users")))
