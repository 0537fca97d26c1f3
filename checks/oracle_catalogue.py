"""DuckDB oracles of the catalogue queries."""

from checks.views import r2, with_views

ITEMS = with_views("items")
BIKES = with_views("bikes")

ITEM_TYPES = [("item_id", "bigint"), ("name", "string"), ("category", "string"),
              ("price", "double"), ("old_price", "string"), ("sellable_online", "boolean"),
              ("other_colors", "string"), ("designer", "string"), ("depth", "double"),
              ("height", "double"), ("width", "double")]

PARSED = ("TRY_CAST(replace(replace(replace(old_price, 'No old price', '0'), 'SR', ''), ',', '')"
          " AS DOUBLE)")
CLEAN = f"coalesce(CASE WHEN {PARSED} = 0 THEN price ELSE {PARSED} END, 0.0)"


def _nulls():
    parts = []
    for c, t in ITEM_TYPES:
        cond = f"{c} IS NULL" + (f" OR isnan({c})" if t == "double" else "")
        parts.append(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {cond}) AS nulls FROM items")
    return ITEMS + "\nUNION ALL\n".join(parts)


def _info():
    parts = [f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null FROM items"
             for c, t in ITEM_TYPES]
    return ITEMS + "\nUNION ALL\n".join(parts)


STATS = """stats AS (SELECT category, min(price) AS min_price, round_even(avg(price), 1) AS mean_price,
                  max(price) AS max_price, sum(price) AS total_price, count(price) AS count
           FROM items GROUP BY category)"""

SQL = {
    "describe": ITEMS + """,
long AS (UNPIVOT (SELECT price, depth, height, width FROM items)
         ON price, depth, height, width INTO NAME "column" VALUE value)
SELECT "column", count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std,
       min(value) AS min, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
       quantile_cont(value, 0.75) AS p75, max(value) AS max
FROM long GROUP BY 1""",
    "null_counts": _nulls(),
    "value_counts": ITEMS + """
SELECT category, count(*) AS count FROM items WHERE category IS NOT NULL GROUP BY 1
ORDER BY count DESC, category""",
    "distinct_values": ITEMS + "SELECT DISTINCT designer FROM items",
    "info": _info(),
    "shape": ITEMS + "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM items",
    "minmax": ITEMS + "SELECT min(price) AS min, max(price) AS max FROM items",
    "count_by": ITEMS + """
SELECT name, count(item_id) AS item_id FROM items GROUP BY name ORDER BY item_id DESC, name""",
    "group_stats": ITEMS + "," + STATS + "\nSELECT * FROM stats ORDER BY min_price",
    "group_means": ITEMS + """
SELECT category, avg(width) AS width, avg(height) AS height, avg(depth) AS depth
FROM items GROUP BY category""",
    "flag_extremes": ITEMS + "," + STATS + """
SELECT category, min_price, max_price,
       min_price = min(min_price) OVER () AS is_min_min_price,
       min_price = max(min_price) OVER () AS is_max_min_price,
       max_price = min(max_price) OVER () AS is_min_max_price,
       max_price = max(max_price) OVER () AS is_max_max_price
FROM stats""",
    "extreme_groups": ITEMS + """,
m AS (SELECT category, avg(price) AS price FROM items GROUP BY category)
SELECT category, price, price = (SELECT max(price) FROM m) AS is_highest FROM m
WHERE price IN ((SELECT min(price) FROM m), (SELECT max(price) FROM m))""",
    "clean_old_price": ITEMS + f"SELECT item_id, price, {CLEAN} AS old_price FROM items",
    "discounts": ITEMS + f""",
d AS (SELECT item_id, price, {CLEAN} AS old_price, {CLEAN} - price AS discount FROM items)
SELECT * FROM d WHERE discount IS NULL OR discount <> 0""",
    "zero_discounts": ITEMS + f"""
SELECT count(item_id) AS items FROM items WHERE {CLEAN} - price = 0""",
    "label_encode": ITEMS + """
SELECT item_id, other_colors, CAST(dense_rank() OVER (ORDER BY other_colors) - 1 AS INTEGER) AS other_colors_le,
       category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS other_category_le
FROM items""",
    "geometry": ITEMS + """
SELECT item_id, depth * height * width / 1000000.0 AS v_furniture, depth * height AS s1,
       width * height AS s2, width * depth AS s3 FROM items""",
    "impute_group_median": ITEMS + """
SELECT item_id, category,
       coalesce(width, median(width) OVER (PARTITION BY category)) AS width,
       coalesce(height, median(height) OVER (PARTITION BY category)) AS height,
       coalesce(depth, median(depth) OVER (PARTITION BY category)) AS depth
FROM items""",
    "complete_cases": ITEMS + """
SELECT item_id, price FROM items
WHERE depth IS NOT NULL AND height IS NOT NULL AND width IS NOT NULL""",
    "map_codes": BIKES + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE CAST(season AS VARCHAR) WHEN '0.0' THEN 'spring' WHEN '1.0' THEN 'summer'
            WHEN '2.0' THEN 'autumn' WHEN '3.0' THEN 'winter' END AS season,
       CASE CAST(weather_code AS VARCHAR) WHEN '1.0' THEN 'Clear' WHEN '2.0' THEN 'Scattered clouds'
            WHEN '3.0' THEN 'Broken clouds' WHEN '4.0' THEN 'Cloudy' WHEN '7.0' THEN 'Rain'
            WHEN '10.0' THEN 'Rain with thunderstorm' WHEN '26.0' THEN 'Snowfall' END AS weather
FROM bikes""",
    "clean_bikes_like": BIKES + """
SELECT "timestamp" AS time, cnt AS count, t1 AS temp_real_C, t2 AS temp_feels_like_C,
       hum / 100 AS humidity_percent, wind_speed AS wind_speed_kph,
       CASE CAST(weather_code AS VARCHAR) WHEN '1.0' THEN 'Clear' WHEN '2.0' THEN 'Scattered clouds'
            WHEN '3.0' THEN 'Broken clouds' WHEN '4.0' THEN 'Cloudy' WHEN '7.0' THEN 'Rain'
            WHEN '10.0' THEN 'Rain with thunderstorm' WHEN '26.0' THEN 'Snowfall' END AS weather,
       is_holiday, is_weekend,
       CASE CAST(season AS VARCHAR) WHEN '0.0' THEN 'spring' WHEN '1.0' THEN 'summer'
            WHEN '2.0' THEN 'autumn' WHEN '3.0' THEN 'winter' END AS season,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM bikes""",
    "round_all": ITEMS + """
SELECT item_id, round_even(price, 2) AS price,
       round_even(depth * height * width / 1000000.0, 2) AS v_furniture,
       round_even(depth * height, 2) AS s1, round_even(width * height, 2) AS s2,
       round_even(width * depth, 2) AS s3 FROM items""",
    "rename_drop": ITEMS + """
SELECT item_id, name AS designer_name, category, price AS price_sr, other_colors,
       depth, height, width FROM items""",
    "shares": ITEMS + f"""
SELECT other_colors, count(*) AS count,
       {r2("count(*) * 100.0 / sum(count(*)) OVER ()", 1)} AS percent
FROM items WHERE other_colors IS NOT NULL GROUP BY other_colors""",
    "binned_scatter": ITEMS + """
SELECT category, floor(price / 1000.0) * 1000.0 AS bin_start, count(*) AS count
FROM items WHERE price IS NOT NULL GROUP BY 1, 2""",
    "regression_line": ITEMS + f""",
c AS (SELECT price, {CLEAN} AS old_price FROM items)
SELECT regr_slope(old_price, price) AS slope, regr_intercept(old_price, price) AS intercept,
       regr_r2(old_price, price) AS r2, regr_count(old_price, price) AS n FROM c""",
    "binned_means": ITEMS + f""",
c AS (SELECT CAST(price AS DOUBLE) AS x, CAST({CLEAN} AS DOUBLE) AS y FROM items),
p AS (SELECT x, y, min(x) OVER () AS lo, max(x) OVER () AS hi FROM c WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT CAST(least(coalesce(floor((x - lo) * 10 / nullif(hi - lo, 0)), 0), 9) AS INTEGER) AS bin,
       round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y, count(*) AS n
FROM p GROUP BY 1""",
    "bar_ci": ITEMS + """
SELECT other_colors, avg(price) AS mean,
       avg(price) - 1.96 * stddev_samp(price) / sqrt(count(price)) AS ci_low,
       avg(price) + 1.96 * stddev_samp(price) / sqrt(count(price)) AS ci_high,
       count(price) AS n
FROM items GROUP BY other_colors""",
    "box_stats": ITEMS + """,
q AS (SELECT other_colors, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
             quantile_cont(price, 0.75) AS q3 FROM items WHERE price IS NOT NULL GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT i.other_colors, f.q1, f.median, f.q3,
       min(price) FILTER (WHERE price BETWEEN lo AND hi) AS whisker_low,
       max(price) FILTER (WHERE price BETWEEN lo AND hi) AS whisker_high,
       count(*) FILTER (WHERE NOT (price BETWEEN lo AND hi)) AS outliers
FROM items i JOIN f USING (other_colors) WHERE price IS NOT NULL
GROUP BY i.other_colors, f.q1, f.median, f.q3""",
}


def _profile(c, t):
    number, text = t in ("bigint", "double"), t == "string"
    x = f"CAST({c} AS DOUBLE)"
    numbers = [f"{f}({x})" if number else "NULL::DOUBLE" for f in ("avg", "stddev_samp", "min", "max")]
    texts = [f"{f}({c})" if text else "NULL::VARCHAR" for f in ("min", "max")]
    names = ("mean", "std", "min_number", "max_number", "min_text", "max_text")
    return (f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS rows, count(*) - count({c}) AS nulls, "
            f"count(DISTINCT {c}) AS distinct_values, "
            + ", ".join(f"{v} AS {n}" for v, n in zip(numbers + texts, names, strict=True)) + " FROM items")


SQL["profile"] = with_views("items") + "\nUNION ALL\n".join(_profile(c, t) for c, t in ITEM_TYPES)
