"""Running sums along an order without one task per group.

Rows are dealt to ranges of (group, order) and frozen with the number of their
range; sums inside a range and totals of the ranges before it add up to the sum
of all rows before, so a group of any size spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.joins import broadcast_if_rows
from quarry.session import cut_lineage


def sums_before(df: DataFrame, within: list[str], order: list[str], weights: list[str]) -> DataFrame:
    """``df`` with ``before_w`` (sum over the rows before, in ``order``, of the same
    ``within``) and ``all_w`` (sum over the whole group) for every weight ``w``.

    ``within`` must be free of NULLs and ``order`` unique in it."""
    keys = [F.col(c) for c in within + order]
    ranged = cut_lineage(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    by = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    held = ranged.groupBy("__range", *within).agg(*[F.sum(w).alias(f"__h_{w}") for w in weights])
    base = held.select(
        "__range", *within,
        *[(F.sum(f"__h_{w}").over(by.orderBy("__range")) - F.col(f"__h_{w}")).alias(f"__b_{w}") for w in weights],
        *[F.sum(f"__h_{w}").over(by).alias(f"all_{w}") for w in weights])
    inner = (Window.partitionBy("__range", *within).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = ranged.select("*", *[(F.sum(w).over(inner) - F.col(w)).alias(f"__i_{w}") for w in weights])
    joined = inside.join(broadcast_if_rows(cut_lineage(base), 200_000), ["__range", *within])
    drop = ["__range", *[f"__i_{w}" for w in weights], *[f"__b_{w}" for w in weights]]
    return joined.withColumns({f"before_{w}": F.col(f"__i_{w}") + F.col(f"__b_{w}") for w in weights}).drop(*drop)
