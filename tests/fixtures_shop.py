"""Hand-made grocery data of FIXTURES.md section 2 (year 2022, 'A' is on the
reduced-VAT list)."""

from datetime import datetime as dt
from decimal import Decimal

from quarry.sources.tables import Shop

UA = "user_id bigint, order_id bigint, action string, time timestamp_ntz"
ORD = "order_id bigint, creation_time timestamp_ntz, product_ids array<bigint>"
PROD = "product_id bigint, name string, price decimal(18,2)"
CA = "courier_id bigint, order_id bigint, action string, time timestamp_ntz"


def shop(spark):
    products = spark.createDataFrame(
        [(1, "A", Decimal("110.00")), (2, "B", Decimal("240.00"))], PROD)
    orders = spark.createDataFrame([
        (10, dt(2022, 8, 30, 9), [1, 2]), (11, dt(2022, 8, 30, 10), [2]),
        (12, dt(2022, 8, 31, 11), [1, 1, 9]), (13, dt(2022, 8, 31, 12), []),
        (14, dt(2022, 10, 1, 8), [2])], ORD)
    actions = spark.createDataFrame([
        (1, 10, "create_order", dt(2022, 8, 30, 9)), (2, 11, "create_order", dt(2022, 8, 30, 10)),
        (2, 11, "cancel_order", dt(2022, 8, 30, 10, 5)), (1, 12, "create_order", dt(2022, 8, 31, 11)),
        (3, 13, "create_order", dt(2022, 8, 31, 12)), (3, 14, "create_order", dt(2022, 10, 1, 8))], UA)
    couriers = spark.createDataFrame([
        (1, 10, "deliver_order", dt(2022, 8, 30, 10)), (1, 11, "deliver_order", dt(2022, 8, 30, 11)),
        (2, 12, "accept_order", dt(2022, 8, 31, 11, 10)), (2, 12, "deliver_order", dt(2022, 8, 31, 12))],
        CA)
    return Shop(actions, orders, products, couriers)
