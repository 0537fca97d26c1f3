"""Cleaning and feature columns for catalogue and sensor tables
(E5, E6, E8-E12, P2, P3, P10-P17). All native column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import ranks
from quarry.operators.joins import broadcast_if_rows
from quarry.session import cut_lineage

# Code books of the bike-hire export (keys are the text of the
# float codes, as the original maps them after a cast to string).
SEASONS = {"0.0": "spring", "1.0": "summer", "2.0": "autumn", "3.0": "winter"}
WEATHER = {"1.0": "Clear", "2.0": "Scattered clouds", "3.0": "Broken clouds",
           "4.0": "Cloudy", "7.0": "Rain", "10.0": "Rain with thunderstorm",
           "26.0": "Snowfall"}
BIKE_COLUMNS = {"timestamp": "time", "cnt": "count", "t1": "temp_real_C",
                "t2": "temp_feels_like_C", "hum": "humidity_percent",
                "wind_speed": "wind_speed_kph", "weather_code": "weather",
                "is_holiday": "is_holiday", "is_weekend": "is_weekend",
                "season": "season"}


def parse_number(col, replacements=(("No old price", "0"), ("SR", ""), (",", ""))):
    """P13 + F7: literal text replacements, then a lenient parse to double
    (text that is not a number becomes NULL)."""
    c = F.col(col).cast("string") if isinstance(col, str) else col.cast("string")
    for old, new in replacements:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c.try_cast("double")


def clean_old_price(df: DataFrame, unparsed: str = "zero") -> DataFrame:
    """E5: text old price -> number; 0 ('No old price') becomes the current
    price (P10); unparsable text becomes 0 (P11), so its discount is
    negative, or stays NULL with ``unparsed='null'``."""
    num = parse_number("old_price")
    fixed = F.when(num == 0, F.col("price")).otherwise(num)
    if unparsed == "zero":
        fixed = F.coalesce(fixed, F.lit(0.0))
    return df.withColumn("old_price", fixed)


def discounts(df: DataFrame) -> DataFrame:
    """discount = old price - price."""
    return df.withColumn("discount", F.col("old_price") - F.col("price"))


def nonzero(df: DataFrame, col: str) -> DataFrame:
    """P5 with pandas semantics: ``x != 0`` keeps missing values."""
    return df.where(F.col(col).isNull() | (F.col(col) != 0))


def label_encode(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Integer codes of each column's sorted distinct values, from 0.
    ``cols`` maps source column -> code column. The code tables have one row
    per class and are broadcast when their estimated size is small."""
    out = df
    for src, dst in cols.items():
        out = out.join(ranks.dense_codes(df, src, dst), src, "left")  # broadcast after a count
    return out


def add_geometry(df: DataFrame) -> DataFrame:
    """Volume in m^3 from cm sides, and the three side areas."""
    d, h, w = F.col("depth"), F.col("height"), F.col("width")
    return df.withColumns({"v_furniture": d * h * w / F.lit(100.0 ** 3),
                           "s1": d * h, "s2": w * h, "s3": w * d})


def impute_group_median(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Fill missing values with the exact median of the item's group
    (a group with no values stays NULL). All columns go through one pass of
    the distributed order statistics in long form ``(group, column, value)``;
    the medians (one row per group) are joined back once."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.selectExpr(f"`{by}`", f"stack({len(cols)}, {pairs}) as (__col, __val)")
    med = ranks.median(long, "__val", [by, "__col"])
    wide = cut_lineage(med.groupBy(by).agg(*[F.max(F.when(F.col("__col") == c, F.col("median")))
                                             .alias(f"__med_{c}") for c in cols]))
    # one row per group: broadcast after a cheap count on the checkpoint, so
    # a few large groups never become a sort-merge join keyed by a few values
    out = df.join(broadcast_if_rows(wide), by, "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"__med_{c}")).alias(c) if c in cols
                        else F.col(c) for c in df.columns])


def complete_cases(df: DataFrame) -> DataFrame:
    """Rows without any NULL (or NaN)."""
    return df.na.drop("any")


def map_codes(col, book: dict[str, str]):
    """Float code -> label via its text form; unmapped codes give NULL."""
    c = F.col(col) if isinstance(col, str) else col
    pairs = [x for k, v in book.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[c.cast("string")]


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns by a dict (unknown names are ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def round_all(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every floating column half-to-even (pandas ``round``)."""
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.bround(c, digits).alias(c) if c in floats else F.col(c)
                       for c in df.columns])


def clean_bikes(df: DataFrame) -> DataFrame:
    """Rename the raw columns, humidity percent -> fraction, season and
    weather codes -> text."""
    out = rename(df, BIKE_COLUMNS)
    return out.withColumns({
        "humidity_percent": F.col("humidity_percent") / 100,
        "season": map_codes("season", SEASONS),
        "weather": map_codes("weather", WEATHER)})
