"""Revenue metrics.

Every job takes the four logical tables (a ``Shop``) and picks its plan:

* Day-level revenue, tax and product shares: with a broadcastable product
  table the units are priced in place and aggregated straight to days (no
  shuffle of units); with a large one, units are first counted per
  ``(day, product)`` map-side so only those pairs are shuffled to the
  product join - ``sum(units x price)`` is the same exact decimal sum.
* Order counts per day come from the valid orders themselves
  (``size(product_ids) > 0``), without the explode.
* Per-order prices (M11, M12) need unit rows; they aggregate per order,
  reusing the order-id partitioning of the anti join.
* Running totals and previous-row comparisons use an unpartitioned window,
  but only over the per-day rows (thousands), never over raw units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.numeric import money_out, pct, ratio, round_half_up
from quarry.operators.joins import (BROADCAST_LIMIT_BYTES, Excluded, estimated_bytes, one_row,
                                    sized_broadcast)
from quarry.plans import engagement as eng
from quarry.session import cut_lineage
from quarry.sources.tables import Shop

OTHER = "ДРУГОЕ"  # fixed value: label of the collapsed small products


def shop_excluded(shop: Shop) -> Excluded:
    """The shop's cancelled orders, frozen once per shop (see ``Shop.derived``)."""
    def build():
        ids = shop.cancelled if shop.cancelled is not None else eng.cancelled_order_ids(shop.user_actions)
        return Excluded(ids, "order_id")
    return shop.derived("excluded", build)


def shop_valid_orders(shop: Shop) -> DataFrame:
    return shop.derived("valid_orders", lambda: shop_excluded(shop).without(shop.orders, "order_id"))


def shop_flagged_actions(shop: Shop) -> DataFrame:
    """Every user action with its date and whether its order is ``valid``."""
    return shop.derived("flagged", lambda: shop_excluded(shop).flag(
        shop.user_actions.select("user_id", "order_id", F.to_date("time").alias("date")), "order_id", "valid"))


def users_per_day(shop: Shop) -> DataFrame:
    """Per day: distinct ``users`` and ``paying_users`` (with an action on a valid order), from one read."""
    per_user = shop_flagged_actions(shop).groupBy("date", "user_id").agg(F.max("valid").alias("valid"))
    return per_user.groupBy("date").agg(
        F.count("user_id").alias("users"), F.count(F.when(F.col("valid"), F.col("user_id"))).alias("paying_users"))


def newcomers_per_day(shop: Shop) -> DataFrame:
    """Per day: ``new_users`` and ``new_paying_users`` (first action, first on a valid order), from one read."""
    firsts = shop_flagged_actions(shop).where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.min("date").alias("any"), F.min(F.when(F.col("valid"), F.col("date"))).alias("paid"))
    tagged = firsts.select(F.explode(F.array(
        F.struct(F.col("any").alias("date"), F.lit(1).alias("n"), F.lit(0).alias("p")),
        F.struct(F.col("paid").alias("date"), F.lit(0).alias("n"), F.lit(1).alias("p")))).alias("d")).select("d.*")
    return tagged.where(F.col("date").isNotNull()).groupBy("date").agg(
        F.sum("n").alias("new_users"), F.sum("p").alias("new_paying_users"))


def valid_lines(shop: Shop) -> DataFrame:
    """One row per unit of a valid order: ``order_id, date, product_id``
    (empty ``product_ids`` give no row, as ``unnest`` does)."""
    return (shop_valid_orders(shop)
            .select("order_id", F.to_date("creation_time").alias("date"),
                    F.explode("product_ids").alias("product_id")))


def priced_counts(shop: Shop, keys: list[str], amounts: dict) -> DataFrame:
    """Per-unit amounts of valid orders summed per ``keys``; ``amounts`` maps
    an output name to a column over the product row (e.g. ``price``).

    With a product table that fits a broadcast (Catalyst's size estimate)
    the units meet it in place and are aggregated straight to ``keys``
    (partial aggregation, no shuffle of units). Otherwise units are first
    counted per ``keys`` + product, so only those pairs are shuffled to the
    product join, and the amounts are ``count x amount``."""
    lines = valid_lines(shop)
    if products_fit_broadcast(shop):
        joined = lines.join(F.broadcast(shop.products), "product_id", "left")
        return joined.groupBy(*keys).agg(*[F.sum(col).alias(name) for name, col in amounts.items()])
    unit_keys = [k for k in keys if k in lines.columns]   # keys may be product columns
    counts = lines.groupBy(*unit_keys, "product_id").agg(F.count(F.lit(1)).alias("__units"))
    joined = counts.join(shop.products, "product_id", "left")
    return joined.groupBy(*keys).agg(*[F.sum(F.col("__units") * col).alias(name)
                                       for name, col in amounts.items()])


def daily_orders(shop: Shop) -> DataFrame:
    """Valid orders with at least one unit, per creation date."""
    return (shop_valid_orders(shop)
            .where(F.size("product_ids") > 0)
            .groupBy(F.to_date("creation_time").alias("date"))
            .agg(F.count(F.lit(1)).alias("orders")))


def order_price(shop: Shop) -> DataFrame:
    """Total price of each valid order (per unit rows, summed per order)."""
    units = valid_lines(shop).join(sized_broadcast(shop.products), "product_id", "left")
    return units.groupBy("order_id").agg(F.sum("price").alias("order_price"))


def daily_revenue(shop: Shop) -> DataFrame:
    """M5: revenue per creation date (decimal sum of unit prices)."""
    return priced_counts(shop, ["date"], {"revenue": F.col("price")})


def products_fit_broadcast(shop: Shop) -> bool:
    size = estimated_bytes(shop.products)
    return size is not None and size <= BROADCAST_LIMIT_BYTES


def daily_orders_revenue(shop: Shop, amounts: dict | None = None) -> DataFrame:
    """Per creation date: ``orders`` (valid orders with a unit), ``revenue``
    and any extra per-unit ``amounts`` (name -> column over the product row).

    Small product table: one pass - units priced in place, summed per order
    (the anti join already partitions by order id, so no shuffle), then per
    day, which also counts the orders. Large product table: the pre-counted
    (day, product) path plus an order count taken from the valid orders."""
    amounts = {"revenue": F.col("price"), **(amounts or {})}
    if products_fit_broadcast(shop):
        units = valid_lines(shop).join(F.broadcast(shop.products), "product_id", "left")
        per_order = units.groupBy("order_id", "date").agg(
            *[F.sum(col).alias(name) for name, col in amounts.items()])
        return per_order.groupBy("date").agg(
            F.count(F.lit(1)).alias("orders"), *[F.sum(n).alias(n) for n in amounts])
    return priced_counts(shop, ["date"], amounts).join(daily_orders(shop), "date")


def revenue_trend(shop: Shop) -> DataFrame:
    """M6: daily revenue, running total, % change vs the previous existing day."""
    w = Window.orderBy("date")
    prev = F.lag("revenue", 1).over(w)
    return (daily_revenue(shop)
            .select("date",
                    money_out("revenue").alias("revenue"),
                    money_out(F.sum("revenue").over(w)).alias("total_revenue"),
                    pct(F.col("revenue") - prev, prev).alias("revenue_change")))


def arpu_daily(shop: Shop) -> DataFrame:
    """M8: ARPU, ARPPU and AOV per creation date (revenue-day spine)."""
    base = daily_orders_revenue(shop).join(users_per_day(shop), "date", "left")
    return base.select(
        "date",
        round_half_up(ratio("revenue", "users")).alias("arpu"),
        round_half_up(ratio("revenue", "paying_users")).alias("arppu"),
        round_half_up(ratio("revenue", "orders")).alias("aov"))


def arpu_running(shop: Shop) -> DataFrame:
    """Running ARPU / ARPPU / AOV: cumulative revenue over cumulative new
    users, new paying users and orders. Days without new users add nothing."""
    w = Window.orderBy("date")
    base = daily_orders_revenue(shop).join(newcomers_per_day(shop), "date", "left")
    run = {c: F.sum(c).over(w) for c in ("revenue", "new_users", "new_paying_users", "orders")}
    return base.select(
        "date",
        round_half_up(ratio(run["revenue"], run["new_users"])).alias("running_arpu"),
        round_half_up(ratio(run["revenue"], run["new_paying_users"])).alias("running_arppu"),
        round_half_up(ratio(run["revenue"], run["orders"])).alias("running_aov"))


def new_user_revenue_share(shop: Shop) -> DataFrame:
    """Revenue on each user's first action date and its share of the
    day's revenue. The first date comes from all actions, revenue per user-day
    from valid actions and the orders' prices, which are frozen once (one narrow
    row per valid order) as they also give the day's revenue."""
    units = valid_lines(shop).join(sized_broadcast(shop.products), "product_id", "left")
    prices = cut_lineage(units.groupBy("order_id", "date").agg(F.sum("price").alias("order_price")))
    per_order = prices.groupBy("order_id").agg(F.sum("order_price").alias("order_price"))
    per_day = (shop_flagged_actions(shop).where(F.col("user_id").isNotNull()).join(per_order, "order_id", "left")
               .groupBy("user_id", "date").agg(F.sum(F.when(F.col("valid"), F.col("order_price"))).alias("revenue")))
    first = per_day.where(F.col("date").isNotNull()).groupBy("user_id").agg(F.min(F.struct("date", "revenue")).alias("f"))
    newcomer = (first.groupBy(F.col("f.date").alias("date"))
                .agg(F.sum(F.coalesce("f.revenue", F.lit(0))).alias("new_users_revenue")))
    daily = prices.groupBy("date").agg(F.sum("order_price").alias("revenue"))
    share = pct("new_users_revenue", "revenue")
    return (daily.join(newcomer, "date", "left")
            .select("date",
                    money_out("revenue").alias("revenue"),
                    money_out("new_users_revenue").alias("new_users_revenue"),
                    share.alias("new_users_revenue_share"),
                    (F.lit(100.0) - share).alias("old_users_revenue_share")))


def product_revenue_share(shop: Shop, min_share: float = 0.5,
                          other: str = OTHER) -> DataFrame:
    """Revenue per product name; names whose rounded share is below
    ``min_share`` percent (or unknown) collapse into ``other``. Shares are
    rounded per name and then summed, as in the original."""
    by_name = priced_counts(shop, ["name"], {"revenue": F.col("price")})
    total = one_row(by_name.agg(F.sum("revenue").alias("__total")))
    share = pct("revenue", "__total")
    labelled = (by_name.crossJoin(total)
                .select(F.when(share >= F.lit(min_share), F.col("name"))
                         .otherwise(F.lit(other)).alias("product_name"),
                        "revenue",
                        share.cast("decimal(18,2)").alias("share")))
    return (labelled.groupBy("product_name")
            .agg(money_out(F.sum("revenue")).alias("revenue"),
                 money_out(F.sum("share")).alias("share_in_revenue"))
            .orderBy(F.desc_nulls_first("revenue")))
