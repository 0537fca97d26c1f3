"""Aggregates behind the catalogue's tables and plots.
Every output is bounded by the number of groups or bins, never by rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import round_half_up
from quarry.operators import ranks
from quarry.operators.joins import broadcast_if_rows, one_row
from quarry.session import cut_lineage


def count_by(df: DataFrame, by: str, col: str) -> DataFrame:
    """Non-null ``col`` count per group, largest first."""
    return (df.groupBy(by).agg(F.count(col).alias(col))
            .orderBy(F.desc_nulls_last(col), F.asc(by)))


def group_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """Min, mean (rounded to 1, half-even), max, sum, count per group,
    sorted by the minimum."""
    return (df.groupBy(by).agg(
        F.min(col).alias(f"min_{col}"),
        F.bround(F.avg(col), 1).alias(f"mean_{col}"),
        F.max(col).alias(f"max_{col}"),
        F.sum(col).alias(f"total_{col}"),
        F.count(col).alias("count"))
        .orderBy(F.asc_nulls_last(f"min_{col}")))


def group_means(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Mean of several columns per group."""
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])


def flag_extremes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Boolean columns marking rows at a column's global min / max (the
    cell highlighting of a styled table). The extremes are one broadcast row."""
    ext = one_row(df.agg(*[F.min(c).alias(f"__min_{c}") for c in cols],
                         *[F.max(c).alias(f"__max_{c}") for c in cols]))
    out = df.crossJoin(ext)
    for c in cols:
        out = out.withColumns({f"is_min_{c}": F.col(c) == F.col(f"__min_{c}"),
                               f"is_max_{c}": F.col(c) == F.col(f"__max_{c}")})
    return out.drop(*[f"__min_{c}" for c in cols], *[f"__max_{c}" for c in cols])


def extreme_groups(df: DataFrame, by: str, col: str) -> DataFrame:
    """Groups whose mean ``col`` is the lowest or the highest."""
    means = df.groupBy(by).agg(F.avg(col).alias(col))
    ext = one_row(means.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi")))
    return (means.crossJoin(ext)
            .where((F.col(col) == F.col("__lo")) | (F.col(col) == F.col("__hi")))
            .select(by, col, (F.col(col) == F.col("__hi")).alias("is_highest")))


def shares(df: DataFrame, col: str, digits: int = 1) -> DataFrame:
    """Value counts with their percentage of non-null rows."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = one_row(counts.agg(F.sum("count").alias("__total")))
    return (counts.crossJoin(total)
            .select(col, "count",
                    round_half_up(F.col("count") * 100.0 / F.col("__total"), digits)
                    .alias("percent")))


def binned_scatter(df: DataFrame, x: str, group: str, width: float) -> DataFrame:
    """Per group, fixed-width bins of ``x`` with counts (a scatter of
    ``x`` by category reduced to a bounded table)."""
    b = F.floor(F.col(x) / F.lit(width))
    return (df.where(F.col(x).isNotNull())
            .groupBy(group, (b * F.lit(width)).alias("bin_start"))
            .agg(F.count(F.lit(1)).alias("count")))


def regression_line(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` with R^2 and pair count."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def binned_means(df: DataFrame, y: str, x: str, bins: int = 10) -> DataFrame:
    """Mean of ``y`` and pair count in equal-width bins of ``x`` (drawn beside the line).
    Pairs with a NULL are left out; a constant ``x`` has one bin."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = one_row(pairs.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    place = F.coalesce(F.floor(F.try_divide((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(0))
    return (pairs.crossJoin(ends).withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
            .groupBy("bin").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.count("*").alias("n")))


def bar_ci(df: DataFrame, by: str, col: str, z: float = 1.96) -> DataFrame:
    """C4: mean per group with a normal 95 % interval (the plotting library
    bootstraps; a normal interval is used instead)."""
    g = df.groupBy(by).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"),
                           F.count(col).alias("n"))
    half = F.lit(z) * F.col("sd") / F.sqrt(F.col("n"))
    return g.select(by, "mean", (F.col("mean") - half).alias("ci_low"),
                    (F.col("mean") + half).alias("ci_high"), "n")


def box_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """Exact quartiles, whiskers (most extreme values within 1.5 IQR) and
    the number of outliers per group."""
    df = cut_lineage(df.select(by, col))  # read by several passes
    q = ranks.quantiles(df, col, [0.25, 0.5, 0.75], by=[by], frozen=True)
    wide = q.groupBy(by).agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(n)
                               for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    iqr = F.col("q3") - F.col("q1")
    fences = wide.select(by, "q1", "median", "q3",
                         (F.col("q1") - 1.5 * iqr).alias("__lo"),
                         (F.col("q3") + 1.5 * iqr).alias("__hi"))
    v = F.col(col)
    inside = (v >= F.col("__lo")) & (v <= F.col("__hi"))
    fences = cut_lineage(fences)     # one row per group; counted, then broadcast
    agg = (df.where(v.isNotNull()).join(broadcast_if_rows(fences), by)
           .groupBy(by, "q1", "median", "q3")
           .agg(F.min(F.when(inside, v)).alias("whisker_low"),
                F.max(F.when(inside, v)).alias("whisker_high"),
                F.count_if(~inside).alias("outliers")))
    return agg

