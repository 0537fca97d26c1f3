"""Exact order statistics by counting: histograms narrow around each wanted rank.

The values (any number of groups at once) are frozen once. Counts, least and
greatest value per group start an interval for each wanted rank; a pass counts the
values of every interval in bins of equal width and keeps, per rank, the bin that
holds it, with the bin's own least and greatest value as the next interval. Bins
are a monotone function of the value, so an interval's values are exactly those
between its ends. When the values left in all intervals are few (``DIRECT``), or an
interval is a single value, the rank is read off.

Only counts of bins are shuffled, summed per task first; a value or group that
holds a third of the rows is a number in a bin. Passes read two columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.joins import broadcast_if_rows
from quarry.session import cut_lineage

DIRECT = 1_000_000  # values that may be counted one by one
BINS = 4096  # of an interval
ALL_BINS = 1 << 21  # of all intervals of a pass
_MAX = 1.7976931348623157e308


def _share(x, lo, hi):
    """Place of x between lo and hi, from 0 to 1, without overflow; infinite values count as the greatest ones."""
    x, lo, hi = (F.greatest(F.least(F.col(c), F.lit(_MAX)), F.lit(-_MAX)) for c in (x, lo, hi))
    return F.when(hi / 2 - lo / 2 < _MAX / 2, F.try_divide(x - lo, hi - lo)).otherwise((x / 2 - lo / 2) / (hi / 2 - lo / 2))


def _read(targets: DataFrame, inside: DataFrame) -> DataFrame:
    """Targets ``g, k, lo, hi, base`` with the value ``x`` of rank k; ``inside``: values with their interval's ends."""
    counted = inside.groupBy("g", "lo", "hi", "x").agg(F.count(F.lit(1)).alias("t"))
    order = Window.partitionBy("g", "lo", "hi").orderBy("x")
    placed = counted.withColumn("start", F.sum("t").over(order) - F.col("t"))
    at = F.col("k") - F.col("base")
    return (placed.join(broadcast_if_rows(targets), ["g", "lo", "hi"])
            .where((F.col("start") <= at) & (at < F.col("start") + F.col("t"))).select("g", "k", "x"))


def values_at(values: DataFrame, ranks: DataFrame, direct: int = DIRECT, report: dict | None = None) -> DataFrame:
    """The value ``x`` of every 0-based rank ``ranks(g, k, lo, hi, n)`` of a group of the frozen ``values(g, x)``."""
    targets = ranks.select("g", "k", "lo", "hi", F.lit(0).cast("long").alias("base"), F.col("n").alias("held"))
    passes = 0
    while True:
        targets = cut_lineage(targets)
        spans = targets.where("lo < hi").select("g", "lo", "hi", "held").distinct()
        left, count = spans.agg(F.sum("held"), F.count("*")).first()
        if report is not None:
            report.setdefault("left", []).append(left or 0)
        if not count:
            return targets.select("g", "k", F.col("lo").alias("x"))
        held = spans.groupBy("g").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # at most one for each rank
        inside = (values.join(broadcast_if_rows(cut_lineage(held)), "g")
                  .withColumn("span", F.get(F.filter("spans", lambda s: F.col("x").between(s["lo"], s["hi"])), 0))
                  .where("span is not null").select("g", "span.lo", "span.hi", "x"))
        if left <= direct:
            return _read(targets.where("lo < hi"), inside).union(
                targets.where("lo = hi").select("g", "k", F.col("lo").alias("x")))
        bins = max(16, min(BINS, ALL_BINS // count))
        place = F.floor(F.coalesce(_share("x", "lo", "hi"), F.lit(0.0)) * bins)
        counts = (inside.withColumn("bin", F.least(place, F.lit(bins - 1)))
                  .groupBy("g", "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("t"), F.min("x").alias("a"), F.max("x").alias("b")))
        order = Window.partitionBy("g", "lo", "hi").orderBy("bin")
        placed = counts.withColumn("start", F.sum("t").over(order) - F.col("t"))
        at = F.col("k") - F.col("base")
        narrowed = (placed.join(broadcast_if_rows(targets.where("lo < hi")), ["g", "lo", "hi"])
                    .where((F.col("start") <= at) & (at < F.col("start") + F.col("t")))
                    .select("g", "k", F.col("a").alias("lo"), F.col("b").alias("hi"),
                            (F.col("base") + F.col("start")).alias("base"), F.col("t").alias("held")))
        targets = narrowed.union(targets.where("lo = hi"))
        passes += 1
        if passes > 400:
            raise RuntimeError("intervals did not narrow")


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None, frozen: bool = False,
              direct: int = DIRECT, report: dict | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics
    (``h = (n-1)q``), one row per ``(by..., q)`` with column ``value``. NULL and NaN
    values are left out. ``frozen``: ``df`` is a checkpoint already."""
    by = list(by or [])
    v = F.col(value)
    group = F.struct(F.lit(0).alias("__one"), *by)  # NULL groups are groups
    narrow = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(
        group.alias("g"), (v.cast("double") + 0.0).alias("x"))
    values = narrow if frozen else cut_lineage(narrow)
    ends = values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    wanted = cut_lineage(ends.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in probs])))
                         .withColumn("h", (F.col("n") - 1) * F.col("q")))
    ranks = wanted.select("g", "lo", "hi", "n", F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("k")).distinct()
    found = broadcast_if_rows(cut_lineage(values_at(values, ranks, direct, report)))
    low = found.select("g", F.col("k").alias("k_lo"), F.col("x").alias("x_lo"))
    high = found.select("g", F.col("k").alias("k_hi"), F.col("x").alias("x_hi"))
    both = (wanted.withColumns({"k_lo": F.floor("h"), "k_hi": F.ceil("h")})
            .join(low, ["g", "k_lo"]).join(high, ["g", "k_hi"]))
    frac = F.col("h") - F.col("k_lo")
    return both.select(*[F.col(f"g.{c}").alias(c) for c in by], "q",
                       F.when(F.col("x_lo") == F.col("x_hi"), F.col("x_lo")).otherwise(
                           F.col("x_lo") + frac * (F.col("x_hi") - F.col("x_lo"))).alias("value"))
