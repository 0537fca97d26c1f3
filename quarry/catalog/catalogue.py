"""Registered catalogue queries: profiling, cleaning, features and chart
aggregates (A6-A18, P2-P17, E1-E13, C1-C5) over the bound items table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog.base import query
from quarry.plans import charts as ch
from quarry.plans import clean as cl
from quarry.plans import profile as pf
from quarry.plans.quality import null_counts
from quarry.sources import tables as tb

SIDES = ["width", "height", "depth"]


def _items(spark, sf):
    return tb.items(spark, sf)


def _clean(spark, sf):
    """Items after the notebook's cleaning steps: price text parsed, discount,
    label codes; sizes still with gaps."""
    items = cl.discounts(cl.clean_old_price(_items(spark, sf)))
    return cl.label_encode(items, {"other_colors": "other_colors_le",
                                   "category": "other_category_le"})


def _imputed(spark, sf):
    return cl.add_geometry(cl.impute_group_median(_clean(spark, sf), "category", SIDES))


@query("profile")
def q_profile(spark, sf):
    return pf.profile_columns(_items(spark, sf))


@query("describe")
def q_describe(spark, sf):
    return pf.describe(_items(spark, sf), ["price", "depth", "height", "width"])


@query("null_counts")
def q_null_counts(spark, sf):
    return null_counts(_items(spark, sf))


@query("value_counts")
def q_value_counts(spark, sf):
    return pf.value_counts(_items(spark, sf), "category")


@query("distinct_values")
def q_distinct_values(spark, sf):
    return pf.distinct_values(_items(spark, sf), "designer")


@query("info")
def q_info(spark, sf):
    return pf.info(_items(spark, sf))


@query("shape")
def q_shape(spark, sf):
    return pf.shape(_items(spark, sf))


@query("minmax")
def q_minmax(spark, sf):
    return pf.minmax(_items(spark, sf), "price")


@query("count_by")
def q_count_by(spark, sf):
    return ch.count_by(_items(spark, sf), "name", "item_id")


@query("group_stats")
def q_group_stats(spark, sf):
    return ch.group_stats(_items(spark, sf), "category", "price")


@query("group_means")
def q_group_means(spark, sf):
    return ch.group_means(_items(spark, sf), "category", SIDES)


@query("flag_extremes")
def q_flag_extremes(spark, sf):
    stats = ch.group_stats(_items(spark, sf), "category", "price")
    return ch.flag_extremes(stats, ["min_price", "max_price"]).select(
        "category", "min_price", "max_price", "is_min_min_price", "is_max_min_price",
        "is_min_max_price", "is_max_max_price")


@query("extreme_groups")
def q_extreme_groups(spark, sf):
    return ch.extreme_groups(_items(spark, sf), "category", "price")


@query("clean_old_price")
def q_clean_old_price(spark, sf):
    return cl.clean_old_price(_items(spark, sf)).select("item_id", "price", "old_price")


@query("discounts")
def q_discounts(spark, sf):
    d = cl.discounts(cl.clean_old_price(_items(spark, sf)))
    return cl.nonzero(d, "discount").select("item_id", "price", "old_price", "discount")


@query("zero_discounts")
def q_zero_discounts(spark, sf):
    d = cl.discounts(cl.clean_old_price(_items(spark, sf)))
    return d.where(F.col("discount") == 0).agg(F.count("item_id").alias("items"))


@query("label_encode")
def q_label_encode(spark, sf):
    return _clean(spark, sf).select("item_id", "other_colors", "other_colors_le",
                                    "category", "other_category_le")


@query("geometry")
def q_geometry(spark, sf):
    return cl.add_geometry(_items(spark, sf)).select("item_id", "v_furniture", "s1", "s2", "s3")


@query("impute_group_median")
def q_impute_group_median(spark, sf):
    return cl.impute_group_median(_items(spark, sf), "category", SIDES).select(
        "item_id", "category", *SIDES)


@query("complete_cases")
def q_complete_cases(spark, sf):
    return cl.complete_cases(_items(spark, sf)).select("item_id", "price")


@query("map_codes")
def q_map_codes(spark, sf):
    bikes = tb.bind_bikes(tb.table(spark, sf, "lineitem"))
    return bikes.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        cl.map_codes("season", cl.SEASONS).alias("season"),
                        cl.map_codes("weather_code", cl.WEATHER).alias("weather"))


@query("clean_bikes_like")
def q_clean_bikes_like(spark, sf):
    bikes = tb.bind_bikes(tb.table(spark, sf, "lineitem"))
    return cl.clean_bikes(bikes)


@query("round_all")
def q_round_all(spark, sf):
    geo = cl.add_geometry(_items(spark, sf)).select("item_id", "price", "v_furniture", "s1", "s2", "s3")
    return cl.round_all(geo, 2)


@query("rename_drop")
def q_rename_drop(spark, sf):
    return (cl.rename(_items(spark, sf), {"name": "designer_name", "price": "price_sr"})
            .drop("old_price", "designer", "sellable_online"))


@query("shares")
def q_shares(spark, sf):
    return ch.shares(_items(spark, sf), "other_colors")


@query("binned_scatter")
def q_binned_scatter(spark, sf):
    return ch.binned_scatter(_items(spark, sf), "price", "category", 1000.0)


@query("regression_line")
def q_regression_line(spark, sf):
    return ch.regression_line(cl.clean_old_price(_items(spark, sf)), "old_price", "price")


@query("binned_means")
def q_binned_means(spark, sf):
    means = ch.binned_means(cl.clean_old_price(_items(spark, sf)), "old_price", "price")
    return means.select("bin", F.round("mean_x", 4).alias("mean_x"), F.round("mean_y", 4).alias("mean_y"), "n")


@query("bar_ci")
def q_bar_ci(spark, sf):
    return ch.bar_ci(_items(spark, sf), "other_colors", "price")


@query("box_stats")
def q_box_stats(spark, sf):
    return ch.box_stats(_items(spark, sf), "other_colors", "price")
