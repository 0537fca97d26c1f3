"""Table profiling (A12-A18, P16, E13): what a notebook's ``info``,
``describe``, ``value_counts``, ``unique``, ``shape`` and ``isna().sum()``
report, each as a DataFrame computed on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import ranks
from quarry.plans.quality import duplicate_count, null_counts
from quarry.session import cut_lineage

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unpivot numeric columns to ``(column, value double)``."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {pairs}) as (column, value)")


def describe(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Per numeric column count, mean, std (sample), min, exact 25/50/75 %
    (linear interpolation) and max. NaN counts as missing. ``approx=True``
    takes the quartiles from ``percentile_approx`` sketches in the same single
    aggregate instead (not interpolated; rank error about 1/10000)."""
    cols = cols or numeric_columns(df)
    long = long_values(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    stats = [F.count("value").alias("count"), F.avg("value").alias("mean"),
             F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
             F.max("value").alias("max")]
    if approx:
        q = F.percentile_approx("value", [0.25, 0.5, 0.75], 10000)
        return (long.groupBy("column").agg(*stats, q.alias("__q"))
                .select("column", "count", "mean", "std", "min",
                        F.col("__q")[0].alias("p25"), F.col("__q")[1].alias("p50"),
                        F.col("__q")[2].alias("p75"), "max"))
    long = cut_lineage(long)  # read by several passes
    basic = long.groupBy("column").agg(*stats)
    qs = ranks.quantiles(long, "value", [0.25, 0.5, 0.75], by=["column"], frozen=True)
    wide = (qs.groupBy("column")
            .agg(F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("p25"),
                 F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"),
                 F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("p75")))
    return basic.join(wide, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def info(df: DataFrame) -> DataFrame:
    """Column, type and non-null count (one pass)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', '{t}', `{c}`" for c, t in df.dtypes)
    return counts.selectExpr(f"stack({len(df.columns)}, {pairs}) as (column, dtype, non_null)")


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.lit(len(df.columns)).cast("bigint").alias("columns"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value, NULL dropped, most frequent first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(col)))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values (NULL kept, as ``unique()`` does)."""
    return df.select(col).distinct()


def minmax(df: DataFrame, col: str) -> DataFrame:
    """Global minimum and maximum."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"))


PROFILE = ("rows", "nulls", "distinct_values", "mean", "std", "min_number", "max_number", "min_text", "max_text")


def profile_columns(df: DataFrame) -> DataFrame:
    """Every column's type, rows, nulls (and NaN), distinct values, and its moments and
    limits (numbers) or first and last value (text), one row each.

    One aggregate in one read: Spark expands each row for the distinct counts, which
    are summed per value before they meet."""
    aggs, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, (c, t) in enumerate(df.dtypes):
        v = F.col(f"`{c}`")
        if t in ("float", "double"):
            v = F.when(~F.isnan(v), v)
        number, text = t in NUMERIC or t.startswith("decimal"), t == "string"
        x = v.cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.countDistinct(v).alias(f"d{i}")]
        if number:
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        if text:
            aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}")]
        no, none = F.lit(None).cast("double"), F.lit(None).cast("string")
        values = (F.col("rows"), F.col("rows") - F.col(f"n{i}"), F.col(f"d{i}"),
                  *([F.col(f"{k}{i}") for k in "msab"] if number else [no] * 4),
                  *([F.col(f"{k}{i}") for k in "ab"] if text else [none] * 2))
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"),
                             *[x.alias(n) for x, n in zip(values, PROFILE, strict=True)]))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def profile(df: DataFrame, key_cols: list[str] | None = None) -> dict[str, DataFrame]:
    """The whole profile as named DataFrames (all lazy)."""
    out = {"shape": shape(df), "info": info(df), "columns": profile_columns(df), "nulls": null_counts(df),
           "duplicates": duplicate_count(df), "describe": describe(df)}
    for c in key_cols or []:
        out[f"unique_{c}"] = distinct_values(df, c)
        out[f"counts_{c}"] = value_counts(df, c)
    return out
