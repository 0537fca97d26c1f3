"""Hypothesis tests and correlations (T1-T6, W7), on the distributed order
statistics of ``quarry.operators.ranks``. Each test reduces to one-row
aggregates; only the final p-value of that single row leaves the JVM."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.normal import norm_ppf, norm_sf
from quarry.operators import ranks
from quarry.session import cut_lineage

CHUNK = 100_000  # positions expanded per task row when a value repeats
SUMS = ("n", "ab", "aa", "bb")  # of a pair of columns: rows, products of their centred ranks


def _poly(coefs, x):
    acc = F.lit(0.0)
    for i, c in enumerate(coefs):
        acc = acc + F.lit(c) * F.pow(x, F.lit(float(i)))
    return acc


# Fixed values of Royston's (1992/1995, AS R94) approximation: weights of the
# two extreme order statistics, mean / log-sd of -log(gamma - log(1 - W)) for
# n = 4 to 11, and of log(1 - W) for n >= 12.
C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
C3 = (0.544, -0.39978, 0.025054, -6.714e-4)
C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
G_SMALL = (-2.273, 0.459)
C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
C6 = (-0.4803, -0.082676, 0.0030302)


def ordinal_positions(df: DataFrame, value: str) -> DataFrame:
    """One row per observation with its 1-based position ``i`` in sorted
    order and the sample size ``n``. Repeated values are expanded in chunks
    that are spread over tasks before the final expansion, so a value that
    holds a third of the rows is not expanded by a single task."""
    pos = ranks.value_positions(df, value)
    chunks = (pos.withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.col("t") - 1) / CHUNK))))
              .withColumn("lo", F.col("start") + F.col("c") * CHUNK + 1)
              .withColumn("hi", F.least(F.col("start") + F.col("t"), F.col("lo") + CHUNK - 1)))
    spread = chunks.repartition("x", "c")
    return spread.select("x", "n", F.explode(F.sequence("lo", "hi")).alias("i"))


def shapiro_wilk(df: DataFrame, value: str) -> DataFrame:
    """Shapiro-Wilk W and p. One row: ``n, w, p``.

    Royston's approximation with its branches for n = 3 (exact), up to 5 (one
    adjusted weight), 4 to 11 and from 12 on; published as accurate up to
    n = 5000. Fewer than three values, or constant ones, have NULL w and p."""
    pos = ordinal_positions(df, value)
    n, size = F.col("n").cast("double"), F.col("n")
    m = norm_ppf((F.col("i") - 0.375) / (n + 0.25))
    i = F.col("i")
    inner = (i > F.when(size <= 5, 1).otherwise(2)) & (i <= size - F.when(size <= 5, 1).otherwise(2))
    agg = pos.groupBy("n").agg(
        F.sum(m * m).alias("S"),
        F.sum(F.when(inner, m * F.col("x"))).alias("M"),
        F.max(F.when(i == 1, F.col("x"))).alias("x1"),
        F.max(F.when(i == 2, F.col("x"))).alias("x2"),
        F.max(F.when(i == size - 1, F.col("x"))).alias("xn1"),
        F.max(F.when(i == size, F.col("x"))).alias("xn"),
        F.max(F.when(i == size, m)).alias("mn"),
        F.max(F.when(i == size - 1, m)).alias("mn1"),
        F.when(F.min("x") < F.max("x"), F.var_samp("x") * (F.count("x") - 1)).alias("SS"))
    r = F.lit(1.0) / F.sqrt(n)
    an = F.try_divide(F.col("mn"), F.sqrt("S")) + _poly(C1, r)
    an1 = F.when(size > 5, F.try_divide(F.col("mn1"), F.sqrt("S")) + _poly(C2, r)).otherwise(0.0)
    pair = F.when(size > 5, F.col("mn1")).otherwise(0.0)
    fac = F.sqrt(F.try_divide(F.col("S") - 2 * F.col("mn") ** 2 - 2 * pair ** 2, 1 - 2 * an ** 2 - 2 * an1 ** 2))
    ax = (F.coalesce(F.try_divide(F.col("M"), fac), F.lit(0.0))
          + an * (F.col("xn") - F.col("x1")) + an1 * (F.col("xn1") - F.col("x2")))
    ax = F.when(size == 3, F.lit(0.5 ** 0.5) * (F.col("xn") - F.col("x1"))).otherwise(ax)
    raw = F.when(size >= 3, F.try_divide(ax * ax, F.col("SS")))
    # least() would take a NaN for a perfect W
    w = F.when(raw.isNotNull() & ~F.isnan(raw), F.least(F.lit(1.0), raw))
    ln = F.log(n)
    y = F.log(F.greatest(F.lit(1.0) - F.col("w"), F.lit(1e-300)))
    gamma = _poly(G_SMALL, n)
    z = (F.when(size >= 12, (y - _poly(C5, ln)) / F.exp(_poly(C6, ln)))
         .when(y < gamma, (-F.log(gamma - y) - _poly(C3, n)) / F.exp(_poly(C4, n))))
    exact = F.greatest(F.lit(0.0), F.lit(6 / math.pi) * (F.asin(F.sqrt("w")) - F.lit(math.asin(0.75 ** 0.5))))
    res = agg.select(F.col("n").cast("bigint").alias("n"), w.alias("w")).withColumn("z", z)
    p = F.when(size == 3, exact).when((size < 12) & (y >= gamma), 0.0).otherwise(norm_sf("z"))
    return res.select("n", "w", F.when(F.col("w").isNotNull(), p).alias("p"))


def kolmogorov_smirnov(df: DataFrame, value: str) -> DataFrame:
    """T1's companion beyond n = 5000: the one-sample Kolmogorov-Smirnov distance of
    ``value`` from the normal distribution of its own mean and deviation.
    One row: ``n, mean, sd, d, p``.

    The distance is read off the distinct values with their ranks (no expansion of
    ties). ``p`` is Kolmogorov's limit with Stephens' small-sample factor; as mean and
    deviation are estimated, it is an upper bound. Constant values have NULL d and p."""
    data = cut_lineage(df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)"))
    told = data.agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    below = F.lit(1.0) - norm_sf(F.try_divide(F.col("x") - F.col("mean"), F.col("sd")))
    pos = ranks.value_positions(data, "x").crossJoin(F.broadcast(told))  # one row
    n = F.col("n").cast("double")
    d = pos.withColumn("f", below).groupBy("n", "mean", "sd").agg(
        F.max(F.greatest((F.col("start") + F.col("t")) / n - F.col("f"), F.col("f") - F.col("start") / n)).alias("d"))
    d = d.withColumn("d", F.when(F.col("sd") > 0, F.col("d")))
    lam = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * F.col("d")
    tail = sum(((-1.0) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(2, 101)), F.exp(-2.0 * lam * lam))
    p = F.when(lam < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * tail)))
    return d.select("n", "mean", "sd", "d", F.when(F.col("d").isNotNull(), p).alias("p"))


def mann_whitney_u(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Two-sided Mann-Whitney U of ``value`` between ``group == a`` and
    ``group == b`` with average ranks for ties, tie-corrected variance and
    continuity correction. One row: ``n1, n2, u1, u2, z``."""
    data = df.where(F.col(value).isNotNull() & F.col(group).isin(a, b))
    pos = ranks.average_ranks(ranks.value_positions(data, value))
    in_a = (data.groupBy(F.col(value).cast("double").alias("x"))
            .agg(F.count_if(F.col(group) == a).alias("ta")))
    ranked = pos.join(in_a, "x")
    s = ranked.agg(
        F.sum("ta").alias("n1"), F.max("n").alias("n"),
        F.sum(F.col("ta") * F.col("rank")).alias("r1"),
        F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    n1, nn = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = nn - n1
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u2 = n1 * n2 - u1
    sigma = F.sqrt(n1 * n2 / 12.0 * ((nn + 1) - F.try_divide(F.col("ties"), nn * (nn - 1))))
    # values that are all equal tell nothing: z = 0
    z = F.when((n1 > 0) & (n2 > 0), F.coalesce(
        F.try_divide(F.greatest(u1, u2) - n1 * n2 / 2.0 - 0.5, sigma), F.lit(0.0)))
    return s.select(F.col("n1").cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"),
                    u1.alias("u1"), u2.alias("u2"), z.alias("z"))


def two_sided_p(z_df: DataFrame) -> DataFrame:
    """p = min(1, 2 * (1 - Phi(z))) for a one-row frame with column ``z``."""
    return z_df.withColumn("p", F.least(F.lit(1.0), 2 * norm_sf(F.col("z"))))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation over rows where both values are present."""
    return df.agg(F.corr(x, y).alias("r"), F.count(F.when(F.col(x).isNotNull()
                                                          & F.col(y).isNotNull(), 1)).alias("n"))


def _mirror(off: DataFrame, cols: list[str]) -> DataFrame:
    both = F.explode(F.array(F.struct("col_a", "col_b", "rho"),
                             F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "rho"))).alias("p")
    diag = off.sparkSession.createDataFrame(
        [(c, c, 1.0) for c in cols], "col_a string, col_b string, rho double")
    return off.select(both).select("p.*").unionByName(diag)


def spearman_matrix(df: DataFrame, cols: list[str], complete: bool | None = None) -> DataFrame:
    """T4: Spearman correlation of every pair of ``cols``, long form
    ``(col_a, col_b, rho)``. As in pandas each pair uses the rows where both
    values are present, ranked afresh (average ranks for ties).

    Two shuffles of blocks (:func:`ranks.ranked_blocks`): each column is ranked, ranks return to the rows they belong
    to, and a block gives the sums of their products. With gaps in some columns (counted unless ``complete`` tells) a column
    is ranked once for each set of such columns that its pairs ask for."""
    # frozen once, with the numbers of the rows
    df = cut_lineage(df.select(*[(F.col(c).cast("double") + 0.0).alias(f"c{i}") for i, c in enumerate(cols)],
                               F.monotonically_increasing_id().alias("__row")))
    pairs = [(a, b) for a in range(len(cols)) for b in range(a + 1, len(cols))]
    there = [F.col(f"c{i}").isNotNull() & ~F.isnan(f"c{i}") for i in range(len(cols))]
    counts = df.agg(F.count(F.lit(1)).alias("__all"), *[F.count_if(t).alias(f"c{i}") for i, t in enumerate(there)]).first()
    gaps = {i for i in range(len(cols)) if (counts[f"c{i}"] != counts["__all"] if complete is None else not complete)}
    asked = [tuple(sorted({a, b} & gaps)) for a, b in pairs]
    sides = sorted({(c, told) for pair, told in zip(pairs, asked, strict=True) for c in pair})
    at = {side: k for k, side in enumerate(sides)}

    def parts(table):
        x = [table[f"c{i}"].to_numpy() for i in range(len(cols))]
        ok = {told: np.logical_and.reduce([~np.isnan(x[i]) for i in told]) if told else slice(None) for told in set(asked)}
        return {k: x[c][ok[told]] for (c, told), k in at.items()}

    def finish(table, found):
        out = {}
        for i, ((a, b), told) in enumerate(zip(pairs, asked, strict=True)):
            ra, rb = (found[at[c, told]] - means[told] for c in (a, b))
            sums = (float(len(ra)), ra @ rb, ra @ ra, rb @ rb) if len(ra) else (None,) * 4
            out |= {f"{name}{i}": pa.array([v], pa.float64()) for name, v in zip(SUMS, sums, strict=True)}
        return pa.table(out)

    # rows that have all of a set of columns, and so the mean of ranks over these
    told_by = sorted(set(asked))
    present = df.agg(*[F.count_if(reduce(lambda p, q: p & q, [there[i] for i in told], F.lit(True))) for told in told_by]).first()
    means = {told: (n + 1) / 2 for told, n in zip(told_by, present, strict=True)}
    rows = counts["__all"]
    ranges = max(math.ceil(rows / ranks.ROWS_PER_RANGE),
                 math.ceil(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) / max(1, len(sides))))
    names = [f"{name}{i}" for i in range(len(pairs)) for name in SUMS]
    sums = ranks.ranked_blocks(df, parts, finish, ", ".join(f"{n} double" for n in names), rows, ranges).agg(
        *[F.sum(n).alias(n) for n in names])
    rho = F.array(*[F.struct(F.lit(cols[a]).alias("col_a"), F.lit(cols[b]).alias("col_b"), F.col(f"n{i}").alias("n"), F.when(
        F.col(f"n{i}") > 1, F.try_divide(F.col(f"ab{i}"), F.sqrt(F.col(f"aa{i}") * F.col(f"bb{i}")))).alias("rho"))
        for i, (a, b) in enumerate(pairs)])
    off = sums.select(F.explode(rho).alias("p")).select("p.*")
    # a pair without common rows has no correlation
    return _mirror((off.where("n > 0") if gaps else off).select("col_a", "col_b", "rho"), cols)


def feature_selection(matrix: DataFrame, target: str, threshold: float) -> DataFrame:
    """T5: features whose |rho| with the target exceeds the threshold."""
    return (matrix.where((F.col("col_a") == target) & (F.col("col_b") != target)
                         & (F.abs("rho") > threshold))
            .select(F.col("col_b").alias("feature"), "rho"))


def decide(p_df: DataFrame, test: str, alpha: float, stat: str) -> DataFrame:
    """Reject / keep the null hypothesis on a one-row test result."""
    return p_df.select(F.lit(test).alias("test"), F.col(stat).cast("double").alias("statistic"),
                       F.col("p"), F.lit(alpha).alias("alpha"),
                       (F.col("p") < alpha).alias("reject"))
