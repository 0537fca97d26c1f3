"""Scans of the base tables (S2) and the bindings of the driver tables to
the logical views the product-metric jobs are written against.

Logical schema of the metric jobs:

* ``user_actions(user_id, order_id, action, time)``
* ``orders(order_id, creation_time, product_ids array<bigint>)``
* ``products(product_id, name, price decimal(18,2))``
* ``courier_actions(courier_id, order_id, action, time)``

The driver data is a TPC-H-like star schema; the binding maps it onto those
views (one customer = one user, one supplier = one courier, one line = one
unit of a product). Every view is a lazy DataFrame over the parquet scans, so
column pruning and predicate pushdown reach the files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_all(spark: SparkSession, sf_dir: str) -> None:
    """Register every driver table as a temporary view of the same name."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


class Shop:
    """The four logical tables of the grocery-delivery schema.

    ``derived`` memoises frames built from them (cancelled ids, valid orders):
    every metric that needs one gets the same DataFrame object, so a report
    combining several metrics plans one subtree for it, which Spark computes
    once and reuses, instead of rescanning per use."""

    def __init__(self, user_actions: DataFrame, orders: DataFrame,
                 products: DataFrame, courier_actions: DataFrame, cancelled: DataFrame | None = None):
        self.user_actions = user_actions
        #: ids of cancelled orders, where the source can give them without reading all actions
        self.cancelled = cancelled
        self.orders = orders
        self.products = products
        self.courier_actions = courier_actions
        self._derived: dict = {}

    def derived(self, key: str, build):
        if key not in self._derived:
            self._derived[key] = build()
        return self._derived[key]


def bind_user_actions(orders: DataFrame) -> DataFrame:
    """Each order is created by its customer at the order time; orders with
    status 'F' are also cancelled one hour later."""
    def act(name, time):
        return F.struct(F.lit(name).alias("action"), time.alias("time"))

    created, later = F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")
    actions = F.when(F.col("o_orderstatus") == "F", F.array(act("create_order", created), act("cancel_order", later))
                     ).otherwise(F.array(act("create_order", created)))
    return orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("order_id"),
                         F.explode(actions).alias("a")).select("user_id", "order_id", "a.action", "a.time")


def bind_cancelled(orders: DataFrame) -> DataFrame:
    """Ids of cancelled orders; the status filter reaches the scan."""
    return orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("order_id"))


def bind_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders with the part keys of their lines as ``product_ids``; an order
    without lines gets an empty array."""
    lines = (lineitem.groupBy("l_orderkey")
             .agg(F.collect_list("l_partkey").alias("product_ids")))
    return (orders.select(F.col("o_orderkey").alias("order_id"),
                          F.col("o_orderdate").alias("creation_time"))
            .join(lines, F.col("order_id") == F.col("l_orderkey"), "left")
            .select("order_id", "creation_time",
                    F.coalesce("product_ids",
                               F.array().cast("array<bigint>")).alias("product_ids")))


def bind_products(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("product_id"),
                       F.col("p_name").alias("name"),
                       F.col("p_retailprice").cast(MONEY).alias("price"))


def bind_courier_actions(lineitem: DataFrame) -> DataFrame:
    """One supplier = one courier; a finished line ('F') is a delivery."""
    return lineitem.select(
        F.col("l_suppkey").alias("courier_id"),
        F.col("l_orderkey").alias("order_id"),
        F.when(F.col("l_linestatus") == "F", F.lit("deliver_order"))
         .otherwise(F.lit("accept_order")).alias("action"),
        F.col("l_shipdate").alias("time"))


def shop(spark: SparkSession, sf_dir: str) -> Shop:
    orders = table(spark, sf_dir, "orders")
    lineitem = table(spark, sf_dir, "lineitem")
    return Shop(user_actions=bind_user_actions(orders),
                orders=bind_orders(orders, lineitem),
                products=bind_products(table(spark, sf_dir, "part")),
                courier_actions=bind_courier_actions(lineitem),
                cancelled=bind_cancelled(orders))


# Names treated as the reduced-VAT list when the driver tables are bound
# (the driver's part names are "<adjective> <noun>"; blue and red items play
# the role of the reference's staple foods).
BOUND_REDUCED_NAMES = tuple(f"{adj} {noun}" for adj in ("blue", "red")
                            for noun in ("anvil", "bolt", "gear", "gizmo",
                                         "plate", "ring", "rod", "widget"))


def thousands(n):
    """Integer text with comma thousands separators ("1,345")."""
    return F.format_number(n, 0)


def bind_items(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Catalogue items (the furniture-catalogue schema) from order lines:
    one line = one item; price = quantity x part list price, category = part type,
    designer = brand; the old price arrives as text in three shapes
    ('No old price', 'SR 1,345', and an unparsable 'SR 1345/4 pack'); the
    three sizes have missing values."""
    j = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_quantity") * F.col("p_retailprice")
    shape = F.col("l_partkey") % 4
    old = (F.when(shape == 0, F.lit("No old price"))
           .when(shape == 1, F.concat(F.lit("SR "), thousands(F.floor(price * 1.2))))
           .when(shape == 2, F.concat(F.lit("SR "), F.floor(price * 1.1).cast("string"),
                                      F.lit("/4 pack")))
           .otherwise(F.concat(F.lit("SR "), F.floor(price).cast("string"))))
    return j.select(
        # order, line number and part; an order can repeat line numbers, so equal ids stay possible
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey") % 100000).alias("item_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        price.alias("price"),
        old.alias("old_price"),
        (F.col("l_returnflag") != "R").alias("sellable_online"),
        F.when(F.col("l_linestatus") == "F", "Yes").otherwise("No").alias("other_colors"),
        F.col("p_brand").alias("designer"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit(None))
         .otherwise(F.col("p_size").cast("double")).alias("depth"),
        F.when(F.col("l_suppkey") % 7 == 0, F.lit(None))
         .otherwise(F.col("l_quantity")).alias("height"),
        F.when(F.col("l_orderkey") % 7 == 0, F.lit(None))
         .otherwise(F.col("p_retailprice") / 10).alias("width"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind_items(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


def bind_bikes(lineitem: DataFrame) -> DataFrame:
    """Hourly bike-hire-like readings from order lines (raw column names and
    float-coded categories as in the original export)."""
    return lineitem.select(
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_quantity").cast("int").alias("cnt"),
        (F.col("l_extendedprice") / 10000).alias("t1"),
        (F.col("l_extendedprice") / 10000 - 1).alias("t2"),
        (F.col("l_discount") * 1000).alias("hum"),
        (F.col("l_tax") * 100).alias("wind_speed"),
        F.col("l_linenumber").cast("double").alias("weather_code"),
        (F.col("l_returnflag") == "R").cast("double").alias("is_holiday"),
        F.dayofweek("l_shipdate").isin(1, 7).cast("double").alias("is_weekend"),
        (F.col("l_partkey") % 5).cast("double").alias("season"),
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
