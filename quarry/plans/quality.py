"""Data-quality checks that replace database constraints (Q1-Q5).

Spark tables carry no enforced keys or NOT NULL (Parquet accepts NULL into a
NOT NULL column), so each constraint becomes a job that reports violations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import broadcast_if_rows
from quarry.session import cut_lineage
from quarry.sources.files import year_range_bucket


def duplicate_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q1: every row (originals included) whose ``cols`` values occur more
    than once; rows with a NULL in ``cols`` never match (SQL equality).

    Skew-safe and shuffle-lean: a 64-bit hash of the key columns is counted
    first (partial aggregation, so a hot key costs one row per task), only
    rows of repeated hashes are kept (semi join), and the exact key
    comparison runs on that candidate set, removing hash collisions.
    """
    h = F.xxhash64(*cols)
    not_null = F.lit(True)
    for c in cols:
        not_null = not_null & F.col(c).isNotNull()
    keyed = df.where(not_null).withColumn("__h", h)
    repeated = cut_lineage(keyed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n"))
                           .where(F.col("__n") > 1).select("__h"))
    # a bounded set of repeated hashes is broadcast, so the rows are never
    # shuffled by key (a hot key stays spread over the scan tasks)
    candidates = keyed.join(broadcast_if_rows(repeated, 5_000_000), "__h", "left_semi")
    dup_keys = (candidates.groupBy("__h", *cols).agg(F.count(F.lit(1)).alias("__n"))
                .where(F.col("__n") > 1).drop("__n"))
    return candidates.join(dup_keys, ["__h", *cols], "left_semi").drop("__h")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Number of repeated full rows (all copies but the first; NULLs
    compare equal here, as in a row-duplicate check). Only rows whose 64-bit
    row hash repeats are shuffled with their full content for the exact
    comparison; everything else moves as one hash per task."""
    cols = df.columns
    keyed = df.withColumn("__h", F.xxhash64(*cols))
    repeated = cut_lineage(keyed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n"))
                           .where(F.col("__n") > 1).select("__h"))
    groups = (keyed.join(broadcast_if_rows(repeated, 5_000_000), "__h", "left_semi")
              .groupBy("__h", *cols).agg(F.count(F.lit(1)).alias("__n")))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint")
                      .alias("duplicates"))


def unique_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q2: key values that occur more than once, with their count. Rows with
    a NULL key part are not compared (a UNIQUE index admits many NULLs)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return (df.where(cond).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULL (and NaN for floating columns) count per column, long
    form ``(column, nulls)``; one pass over the data."""
    cols = cols or df.columns
    kinds = dict(df.dtypes)
    aggs = []
    for c in cols:
        isnull = F.col(c).isNull()
        if kinds[c] in ("double", "float"):
            isnull = isnull | F.isnan(F.col(c))
        aggs.append(F.count_if(isnull).alias(c))
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) as (column, nulls)")


def null_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q3: NOT NULL check as a report: columns with at least one NULL."""
    return null_counts(df, cols).where(F.col("nulls") > 0)


def type_violations(df: DataFrame, key: str, spec: dict) -> DataFrame:
    """Q4: values that break a declared type, long form ``(key, column, value,
    reason)``. ``spec`` maps a column to ``("varchar", n)``, ``("char", n)``,
    ``("date",)`` or ``("double",)``; text that does not parse is reported,
    as is text longer than the declared length. One pass: each row yields an
    array of its violations, which is exploded."""
    checks = []
    for c, rule in spec.items():
        v = F.col(c).cast("string")
        kind = rule[0]
        if kind in ("varchar", "char"):
            bad, why = F.length(v) > rule[1], f"longer than {rule[1]}"
        elif kind in ("date", "double", "int", "bigint"):
            bad, why = v.isNotNull() & v.try_cast(kind).isNull(), f"not a {kind}"
        else:
            raise ValueError(f"unknown rule {rule!r}")
        checks.append(F.when(bad, F.struct(F.lit(c).alias("column"), v.alias("value"),
                                           F.lit(why).alias("reason"))))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return (df.select(F.col(key).alias("key"), F.explode(found).alias("v"))
            .select("key", "v.column", "v.value", "v.reason"))


def partition_counts(df: DataFrame, date_col: str, first_upper: int, last_lower: int) -> DataFrame:
    """Q5: rows per year-range partition (labels as in ``year_range_bucket``)."""
    return (df.groupBy(year_range_bucket(date_col, first_upper, last_lower).alias("part_year"))
            .agg(F.count(F.lit(1)).alias("rows")))
