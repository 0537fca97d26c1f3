"""Join building blocks: size-checked broadcast and null-aware NOT IN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

# Upper bound for an explicit broadcast hint. Above it the hint is dropped and
# the planner keeps a shuffle join (sort-merge, or AQE's own runtime choice).
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (the same statistic the
    planner compares with ``autoBroadcastJoinThreshold``); None if unknown."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except AttributeError:  # Spark Connect has no local plan
        return None


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimated size is known and below
    ``limit``; otherwise return ``df`` unchanged so a shuffle join is planned."""
    size = estimated_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df


def broadcast_if_rows(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast hint after counting the rows - for checkpointed tables, whose
    count is a cheap read while Catalyst has no size estimate for them."""
    return F.broadcast(df) if df.count() <= max_rows else df


def one_row(df: DataFrame) -> DataFrame:
    """Broadcast a global (one-row) aggregate; its size is fixed by construction."""
    return F.broadcast(df)


def not_in(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """``left WHERE left_key NOT IN (SELECT right_key FROM right)`` with SQL's
    three-valued semantics, planned as a shuffle anti join.

    Spark plans a literal ``NOT IN`` subquery as a null-aware broadcast anti
    join, i.e. the whole right side is broadcast whatever its size. Here the
    right keys go through an ordinary ``left_anti`` join (sort-merge at scale,
    AQE may still pick broadcast when small) and the NULL cases are applied
    from a one-row summary of the right side:

    * right side empty        -> every left row is kept, NULL keys included;
    * right side holds a NULL -> no row survives;
    * otherwise               -> rows with a NULL left key are dropped.
    """
    keys = right.select(F.col(right_key).alias("__nk"))
    summary = one_row(keys.agg(
        F.count(F.lit(1)).alias("__n_all"),
        F.count_if(F.col("__nk").isNull()).alias("__n_null"),
    ))
    kept = left.join(keys.where(F.col("__nk").isNotNull()),
                     left[left_key] == keys["__nk"], "left_anti")
    guarded = kept.crossJoin(summary).where(
        (F.col("__n_all") == 0)
        | ((F.col("__n_null") == 0) & F.col(left_key).isNotNull()))
    return guarded.drop("__n_all", "__n_null")


class Excluded:
    """The right side of a NOT IN that several parts of a report share, frozen once.

    The distinct keys are one narrow checkpoint; whether there are any, and a NULL
    among them, is known then, so every use is a plain join without a second read."""

    def __init__(self, right: DataFrame, key: str):
        held = cut_lineage(right.select(F.col(key).alias("__nk")).distinct())
        told = held.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__nk").isNull()).alias("nulls")).first()
        self.none, self.null = told["n"] == 0, told["nulls"] > 0
        self.keys = held.where(F.col("__nk").isNotNull())

    def without(self, left: DataFrame, key: str) -> DataFrame:
        """``left WHERE key NOT IN (...)``, as :func:`not_in`."""
        if self.none:
            return left
        if self.null:
            return left.where(F.lit(False))
        return left.where(F.col(key).isNotNull()).join(self.keys, F.col(key) == F.col("__nk"), "left_anti")

    def flag(self, left: DataFrame, key: str, name: str) -> DataFrame:
        """``left`` with ``name``: whether ``key NOT IN (...)`` is true."""
        def told(c: Column) -> DataFrame:
            return left.withColumn(name, c)

        if self.none or self.null:
            return told(F.lit(self.none))
        marked = left.join(self.keys.withColumn("__in", F.lit(True)), F.col(key) == F.col("__nk"), "left")
        return marked.withColumn(name, F.col("__in").isNull() & F.col(key).isNotNull()).drop("__in", "__nk")
