"""Unit economics (M14-M18): tax, deliveries, courier bonus, cost model and
the gross-profit report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.numeric import money_out, pct
from quarry.plans import revenue as rev
from quarry.sources.tables import Shop

# Fixed values of the original cost model: reduced-VAT product names (10 % VAT
# included in the price, everything else 20 %) and the monthly tariffs.
REDUCED_VAT_NAMES = (
    "сахар", "сухарики", "сушки", "семечки", "масло льняное", "виноград",
    "масло оливковое", "арбуз", "батон", "йогурт", "сливки", "гречка",
    "овсянка", "макароны", "баранина", "апельсины", "бублики", "хлеб", "горох",
    "сметана", "рыба копченая", "мука", "шпроты", "сосиски", "свинина", "рис",
    "масло кунжутное", "сгущенка", "ананас", "говядина", "соль",
    "рыба вяленая", "масло подсолнечное", "яблоки", "груши", "лепешка",
    "молоко", "курица", "лаваш", "вафли", "мандарины",
)
# (month, fixed per day, per order packed, per order delivered, per bonus courier)
TARIFFS = ((8, 120000, 140, 150, 400), (9, 150000, 115, 150, 500))
DELIVER = "deliver_order"


def vat(price="price", name="name", reduced=REDUCED_VAT_NAMES) -> Column:
    """VAT contained in a unit price, rounded per unit to cents:
    ``price/110*10`` for reduced-rate names, ``price/120*20`` otherwise
    (an unknown name takes the standard rate; a NULL price gives NULL)."""
    p = F.col(price) if isinstance(price, str) else price
    n = F.col(name) if isinstance(name, str) else name
    return (F.when(n.isin(list(reduced)), F.round(p / 110 * 10, 2))
             .otherwise(F.round(p / 120 * 20, 2)))


def daily_sales(shop: Shop, reduced=REDUCED_VAT_NAMES) -> DataFrame:
    """Per creation date: orders packed, revenue and tax (exact decimal sums
    of per-unit amounts, from units counted per day and product)."""
    return (rev.daily_orders_revenue(shop, {"tax": vat(reduced=reduced)})
            .withColumnRenamed("orders", "orders_packed"))


def valid_deliveries(shop: Shop) -> DataFrame:
    """Distinct ``(date, courier_id, order_id)`` deliveries of valid orders."""
    delivered = shop.courier_actions.where(F.col("action") == DELIVER)
    valid = rev.shop_excluded(shop).without(delivered, "order_id")
    return valid.select(F.to_date("time").alias("date"), "courier_id", "order_id").distinct()


def orders_delivered(shop: Shop, deliveries: DataFrame | None = None) -> DataFrame:
    """Distinct valid orders delivered per day."""
    d = deliveries if deliveries is not None else valid_deliveries(shop)
    return d.groupBy("date").agg(F.countDistinct("order_id").alias("orders_delivered"))


def bonus_couriers(shop: Shop, min_orders: int = 5,
                   deliveries: DataFrame | None = None) -> DataFrame:
    """Per day, couriers who delivered at least ``min_orders`` distinct
    valid orders that day."""
    d = deliveries if deliveries is not None else valid_deliveries(shop)
    per_courier = (d.groupBy("date", "courier_id").agg(F.count(F.lit(1)).alias("n"))
                   .where(F.col("n") >= min_orders))
    return per_courier.groupBy("date").agg(F.count("courier_id").alias("couriers_count"))


def cost_expr(date="date", packed="orders_packed", delivered="orders_delivered",
              couriers="couriers_count", tariffs=TARIFFS) -> Column:
    """Daily costs by month tariff; months without a tariff give NULL."""
    month = F.month(F.col(date))
    expr = None
    for m, fixed, per_packed, per_delivered, per_courier in tariffs:
        value = (F.lit(fixed)
                 + F.lit(per_packed) * F.coalesce(F.col(packed), F.lit(0))
                 + F.lit(per_delivered) * F.coalesce(F.col(delivered), F.lit(0))
                 + F.lit(per_courier) * F.coalesce(F.col(couriers), F.lit(0)))
        expr = F.when(month == m, value) if expr is None else expr.when(month == m, value)
    return expr


def daily_costs(shop: Shop, min_orders: int = 5, reduced=REDUCED_VAT_NAMES,
                tariffs=TARIFFS) -> DataFrame:
    """Per sales day: revenue, tax, orders packed / delivered, bonus couriers
    and the cost of the day (the day spine is the sales days). Deliveries are
    de-duplicated once and feed both delivery aggregates."""
    deliveries = valid_deliveries(shop)
    return (daily_sales(shop, reduced)
            .join(orders_delivered(shop, deliveries), "date", "left")
            .join(bonus_couriers(shop, min_orders, deliveries), "date", "left")
            .withColumn("costs", cost_expr(tariffs=tariffs)))


def gross_profit_report(shop: Shop, min_orders: int = 5, reduced=REDUCED_VAT_NAMES,
                        tariffs=TARIFFS) -> DataFrame:
    """Daily and cumulative revenue, costs, tax and gross profit with
    ratios. Days without a tariff have NULL costs, hence NULL profit, and the
    running sums skip them."""
    w = Window.orderBy("date")
    day = daily_costs(shop, min_orders, reduced, tariffs)
    gross = F.col("revenue") - F.col("costs") - F.col("tax")
    running = day.select(
        "date", "revenue", "costs", "tax", gross.alias("gross_profit"),
        F.sum("revenue").over(w).alias("total_revenue"),
        F.sum("costs").over(w).alias("total_costs"),
        F.sum("tax").over(w).alias("total_tax"),
        F.sum(gross).over(w).alias("total_gross_profit"))
    money = ["revenue", "costs", "tax", "gross_profit", "total_revenue",
             "total_costs", "total_tax", "total_gross_profit"]
    return running.select(
        "date", *[money_out(c).alias(c) for c in money],
        pct("gross_profit", "revenue").alias("gross_profit_ratio"),
        pct("total_gross_profit", "total_revenue").alias("total_gross_profit_ratio"))
