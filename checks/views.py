"""The table bindings of ``quarry.sources.tables`` written as DuckDB CTEs, so
each oracle query is self-contained SQL over the driver's views.

The logical ``orders`` view is called ``shop_orders`` here to keep it apart
from the driver's own ``orders`` view.
"""

VIEWS = {
    "user_actions": """
  SELECT o_custkey AS user_id, o_orderkey AS order_id, 'create_order' AS action,
         o_orderdate AS time
  FROM orders
  UNION ALL
  SELECT o_custkey, o_orderkey, 'cancel_order', o_orderdate + INTERVAL 1 HOUR
  FROM orders WHERE o_orderstatus = 'F'""",
    "shop_orders": """
  SELECT o.o_orderkey AS order_id, o.o_orderdate AS creation_time,
         coalesce(l.product_ids, []::BIGINT[]) AS product_ids
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, list(l_partkey) AS product_ids
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "products": """
  SELECT p_partkey AS product_id, p_name AS name,
         CAST(p_retailprice AS DECIMAL(18,2)) AS price
  FROM part""",
    "courier_actions": """
  SELECT l_suppkey AS courier_id, l_orderkey AS order_id,
         CASE WHEN l_linestatus = 'F' THEN 'deliver_order' ELSE 'accept_order' END AS action,
         l_shipdate AS time
  FROM lineitem""",
}


def with_views(*names: str, extra: str = "") -> str:
    """``WITH`` clause defining the named logical views (plus extra CTEs)."""
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


def r2(expr: str, scale: int = 2) -> str:
    """SQL of ``quarry.functions.numeric.round_half_up``."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,10)), {scale}) AS DOUBLE)"


def ratio(num: str, den: str) -> str:
    return f"(CAST(({num}) AS DOUBLE) / NULLIF(CAST(({den}) AS DOUBLE), 0))"


def pct(num: str, den: str) -> str:
    return r2(f"{ratio(num, den)} * 100.0")


ITEMS = """
  SELECT (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000 AS item_id,
         p_name AS name, p_type AS category, l_quantity * p_retailprice AS price,
         CASE l_partkey % 4
           WHEN 0 THEN 'No old price'
           WHEN 1 THEN 'SR ' || format('{:,}', CAST(floor(l_quantity * p_retailprice * 1.2) AS BIGINT))
           WHEN 2 THEN 'SR ' || CAST(CAST(floor(l_quantity * p_retailprice * 1.1) AS BIGINT) AS VARCHAR) || '/4 pack'
           ELSE 'SR ' || CAST(CAST(floor(l_quantity * p_retailprice) AS BIGINT) AS VARCHAR) END AS old_price,
         l_returnflag <> 'R' AS sellable_online,
         CASE WHEN l_linestatus = 'F' THEN 'Yes' ELSE 'No' END AS other_colors,
         p_brand AS designer,
         CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS depth,
         CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_quantity END AS height,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE p_retailprice / 10 END AS width
  FROM lineitem JOIN part ON l_partkey = p_partkey"""

VIEWS["items"] = ITEMS

VIEWS["bikes"] = """
  SELECT l_shipdate AS "timestamp", CAST(l_quantity AS INTEGER) AS cnt,
         l_extendedprice / 10000 AS t1, l_extendedprice / 10000 - 1 AS t2,
         l_discount * 1000 AS hum, l_tax * 100 AS wind_speed,
         CAST(l_linenumber AS DOUBLE) AS weather_code,
         CAST(l_returnflag = 'R' AS DOUBLE) AS is_holiday,
         CAST(dayofweek(l_shipdate) IN (0, 6) AS DOUBLE) AS is_weekend,
         CAST(l_partkey % 5 AS DOUBLE) AS season,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem"""
