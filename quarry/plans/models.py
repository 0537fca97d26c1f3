"""Price models and nearest neighbours.

* Regressors are MLlib estimators (distributed fits); metrics are plain
  aggregates over the test predictions. Boosted trees are fitted on weighted
  cells of binned features, which stand for all train rows.
* Votes and means of nearest neighbours work on the table that
  ``quarry.operators.neighbours`` gives.
* The kernel model (re-aimed from an RBF support-vector regressor) is a ridge
  fit on random Fourier features, from sums that tasks take in numpy.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.joins import one_row
from quarry.plans.trees import bin_counts
from quarry.session import cut_lineage

FEATURES = ["depth", "height", "width", "s1", "s2", "s3"]
SEED = 5


# --- L1 / L2: features and split -----------------------------------------------------------

def ml_frame(df: DataFrame, id_col: str = "item_id", features=FEATURES,
             target: str = "price") -> DataFrame:
    """L1: id, rounded features (half-even, 2 digits) and the integer label
    (truncated toward zero), complete rows only."""
    cols = [F.bround(F.col(c).cast("double"), 2).alias(c) for c in features]
    label = F.bround(F.col(target).cast("double"), 2).cast("int").alias("label")
    return df.select(id_col, *cols, label).na.drop("any")


def hash_split(df: DataFrame, id_col: str, train_tenths: int = 7) -> DataFrame:
    """L2: stable train/test flag from the id (first 32 bits of its md5), the
    same on any partitioning or recomputation."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("split", F.when(h % 10 < train_tenths, "train").otherwise("test"))


def assemble(df: DataFrame, features=FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


# --- L7-L11, L13-L15: regressors and metrics --------------------------------------------

def metrics(pred: DataFrame, name: str, label: str = "label",
            prediction: str = "prediction") -> DataFrame:
    """RMSE and R^2 of predictions, one row."""
    y, p = F.col(label).cast("double"), F.col(prediction)
    s = pred.agg(F.avg((y - p) ** 2).alias("mse"), F.var_pop(y).alias("var"),
                 F.count(F.lit(1)).alias("n"))
    return s.select(F.lit(name).alias("model"), F.sqrt("mse").alias("rmse"),
                    (F.lit(1.0) - F.try_divide("mse", "var")).alias("r2"), "n")


ESTIMATORS = {
    "linear": lambda **p: LinearRegression(featuresCol="features", labelCol="label", solver="normal", **p),
    "tree": lambda **p: DecisionTreeRegressor(featuresCol="features", labelCol="label", seed=SEED, **p),
    "forest": lambda **p: RandomForestRegressor(featuresCol="features", labelCol="label", seed=SEED, **p),
    "gbt": lambda **p: GBTRegressor(featuresCol="features", labelCol="label", seed=SEED, **p),
}
# Sizes of the original analyses (30 is MLlib's greatest depth, the original has no bound).
SIZES = {"linear": {}, "tree": {"maxDepth": 30}, "forest": {"numTrees": 100, "maxDepth": 30},
         "gbt": {"maxIter": 100, "maxDepth": 3}}


def fit_predict(split: DataFrame, kind: str, features=FEATURES, **params) -> DataFrame:
    """Fit one MLlib regressor on the train rows, predict the test rows;
    ``params`` replace sizes of ``SIZES``."""
    if kind == "gbt":
        return _boosted(cut_lineage(split), list(features), {**SIZES[kind], **params})
    data = assemble(cut_lineage(split), features)
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    model = ESTIMATORS[kind](**{**SIZES[kind], **params}).fit(train)
    return model.transform(test)


MAX_BINS = 32  # MLlib's default
CELLS_PER_TASK = 20_000


def bin_cuts(values: list[tuple[float, float, float]], bins: int) -> list[float]:
    """Ends of at most ``bins`` bins by MLlib's rule, from all values of a feature in order as ``(least, greatest,
    rows)``: every value its own bin if they are few, else bins of about equal rows."""
    def cut(i):
        (_, a, _), (b, _, _) = values[i - 1:i + 1]
        mid = a / 2 + b / 2
        return a if mid >= b else max(a, mid)

    if len(values) <= bins:
        return [cut(i) for i in range(1, len(values))]
    stride = sum(n for _, _, n in values) / bins
    found, count, target = [], values[0][2], stride
    for i in range(1, len(values)):
        before, count = count, count + values[i][2]
        if abs(before - target) < abs(count - target):
            found.append(cut(i))
            target += stride
    return found


def _boosted(data: DataFrame, features: list[str], params: dict) -> DataFrame:
    """MLlib's boosted trees on cells instead of rows.

    MLlib bins every feature first (its ends from a sample of 10,000 rows, here from counts of all rows) and
    then passes over all rows some 400 times. Trees know a row by its bins alone, and the squared error prefers
    the same splits for rows and for the mean label of the rows of a cell, weighted by their number. So train rows are
    aggregated to cells (one row for each combination of bins) once, and the fit passes over these."""
    k, bins = len(features), params.get("maxBins", MAX_BINS)
    train, test = (data.where(F.col("split") == kind) for kind in ("train", "test"))
    cuts = [bin_cuts(values, bins) for values in bin_counts(train, features, bins)]
    binned = [f"__bin{i}" for i in range(k)]
    split = [i for i in range(k) if cuts[i]]
    # Bucketizer's buckets begin with their least value, bins end with their greatest one
    bucketizer = Bucketizer(
        inputCols=[f"__x{i}" for i in split], outputCols=[binned[i] for i in split],
        splitsArray=[[-math.inf, *(float(np.nextafter(c, math.inf)) for c in cuts[i]), math.inf] for i in split])
    assembler = VectorAssembler(inputCols=binned, outputCol="bins")

    def place(df):
        df = df.withColumns({f"__x{i}": F.col(c).cast("double") for i, c in enumerate(features)})
        if split:
            df = bucketizer.transform(df)
        # numbers, not the classes that Bucketizer declares them to be: MLlib would not keep their order
        return df.withColumns({b: F.col(b) + 0.0 if i in split else F.lit(0.0) for i, b in enumerate(binned)})

    cells = cut_lineage(place(train).groupBy(*binned).agg(
        F.avg(F.col("label").cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("rows")))
    many = cells.count()
    parts = max(1, math.ceil(many / CELLS_PER_TASK))
    # with this many bins allowed MLlib draws no sample of the cells: each bin, a number now, is an end
    params = {**params, "maxBins": max(bins, math.isqrt(many) + 1)}
    model = ESTIMATORS["gbt"](**params, weightCol="rows").setFeaturesCol("bins").fit(
        assembler.transform(cells.repartition(parts, *binned).sortWithinPartitions(*binned)))
    return model.transform(assembler.transform(place(test))).drop(*binned, *[f"__x{i}" for i in range(k)])


def least_squares(split: DataFrame, features=FEATURES, label: str = "label") -> DataFrame:
    """Least squares with an intercept; the test rows with ``prediction``.

    Means and the Gram matrix of the centred train columns are one aggregate (one
    row); the normal equations are solved by elimination on it. A feature that is
    constant, or a linear function of those before it, gets the coefficient 0."""
    data = cut_lineage(split)
    train = data.where(F.col("split") == "train")
    names = [*features, label]
    values = {c: F.col(c).cast("double") for c in names}
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(names))]
    row = train.agg(*[F.avg(values[c]).alias(f"m{i}") for i, c in enumerate(names)],
                    *[F.covar_pop(values[names[i]], values[names[j]]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    test = data.where(F.col("split") == "test")
    if row["m0"] is None:
        return test.withColumn("prediction", F.lit(None).cast("double"))
    k = len(features)
    a = [[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k)]
    beta = eliminate(a)
    intercept = row[f"m{k}"] - sum(b * row[f"m{i}"] for i, b in enumerate(beta))
    guess = reduce(lambda p, q: p + q, [F.lit(b) * values[c] for b, c in zip(beta, features, strict=True)], F.lit(intercept))
    return test.withColumn("prediction", guess)


def eliminate(a: list[list[float]]) -> list[float]:
    """Solution of the normal equations ``a`` (right side in the last column), a symmetric non-negative matrix."""
    k = len(a)
    a, scale = [list(r) for r in a], [a[i][i] for i in range(k)]
    free = [False] * k
    for p in range(k):
        free[p] = a[p][p] <= 1e-12 * scale[p]
        if not free[p]:
            for r in range(p + 1, k):
                q = a[r][p] / a[p][p]
                a[r] = [x - q * y for x, y in zip(a[r], a[p], strict=True)]
    beta = [0.0] * k
    for p in reversed(range(k)):
        if not free[p]:
            beta[p] = (a[p][k] - sum(a[p][j] * beta[j] for j in range(p + 1, k))) / a[p][p]
    return beta


def fourier_features(df: DataFrame, features=FEATURES, d: int = 40, gamma: float | None = None,
                     seed: int = SEED) -> tuple[DataFrame, list[str]]:
    """Random Fourier features approximating an RBF kernel
    ``exp(-gamma |x - y|^2)`` on standardised inputs (default gamma = 1 /
    n_features, the usual RBF default). Means and deviations are one
    broadcast row of the train rows, if a column ``split`` tells them; the ``d`` projections are literals in the plan."""
    k = len(features)
    omega, phase = _draws(k, d, gamma, seed)
    fitted = df.where(F.col("split") == "train") if "split" in df.columns else df
    stats = one_row(fitted.agg(*[F.avg(c).alias(f"__m_{c}") for c in features],
                               *[F.stddev_pop(c).alias(f"__s_{c}") for c in features]))
    # a constant feature tells nothing
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0)) for c in features}
    scale = math.sqrt(2.0 / d)
    names = [f"rff_{j}" for j in range(d)]
    cols = []
    for j in range(d):
        dot = reduce(lambda a, b: a + b, [F.lit(float(omega[j, i])) * z[c]
                                          for i, c in enumerate(features)])
        cols.append((F.lit(scale) * F.cos(dot + F.lit(float(phase[j])))).alias(names[j]))
    keep = [c for c in df.columns]
    return df.crossJoin(stats).select(*keep, *cols), names


def _draws(k: int, d: int, gamma: float | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``d`` projections of the kernel and their phases."""
    gamma = gamma if gamma is not None else 1.0 / k
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, math.sqrt(2 * gamma), size=(d, k)), rng.uniform(0.0, 2 * math.pi, size=d)


def ridge(n: float, sums: np.ndarray, products: np.ndarray, reg: float) -> tuple[np.ndarray, float]:
    """Ridge regression from the number of rows and the sums and products of centred features and label (the
    last column): the penalty is on standardised coefficients, relative to the label's deviation, as in MLlib."""
    mean = sums / n
    cov = products / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 0.0))
    # a constant feature tells nothing; neither does any about a constant label
    told = np.flatnonzero(dev[:-1] > 1e-12 * (1 + np.abs(mean[:-1])))
    beta = np.zeros(len(mean) - 1)
    if len(told) and dev[-1] > 0:
        a = cov[np.ix_(told, told)] / np.outer(dev[told], dev[told])
        right = cov[told, -1] / (dev[told] * dev[-1])
        beta[told] = np.linalg.solve(a + reg / dev[-1] * np.eye(len(told)), right) * dev[-1] / dev[told]
    return beta, float(mean[-1] - beta @ mean[:-1])


def kernel_predict(split: DataFrame, features=FEATURES, d: int = 40, reg: float = 1e-3) -> DataFrame:
    """Ridge regression on the Fourier features of :func:`fourier_features`.

    One aggregate gives means and deviations; tasks sum up the products of their rows' Fourier features (a row
    of (d + 1)^2 numbers each leaves a task); the test rows are predicted in tasks."""
    data = cut_lineage(split)
    train, test = (data.where(F.col("split") == kind) for kind in ("train", "test"))
    k = len(features)
    omega, phase = _draws(k, d, None, SEED)
    row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)],
                    F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        return test.withColumn("prediction", F.lit(None).cast("double"))
    mean, dev = (np.array([float(row[f"{x}{i}"]) for i in range(k)]) for x in "ms")
    centre = float(row["y"])  # of the label, so that products stay small

    def fourier(batch):
        x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in features], axis=1)
        z = np.where(dev > 0, (x - mean) / np.where(dev > 0, dev, 1.0), 0.0)
        return math.sqrt(2.0 / d) * np.cos(z @ omega.T + phase)

    def summed(batches):
        total = np.zeros((d + 2, d + 2))
        for batch in batches:
            if batch.num_rows:
                own = np.c_[fourier(batch), batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64) - centre,
                            np.ones(batch.num_rows)]
                total += own.T @ own
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(total.size, dtype=np.int32)), "s": pa.array(total.ravel())})

    sums = train.select(*features, "label").mapInArrow(summed, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    total = np.zeros((d + 2) ** 2)
    for r in sums.collect():  # (d + 2)^2 rows
        total[r["i"]] = r["s"]
    total = total.reshape(d + 2, d + 2)
    beta, intercept = ridge(total[-1, -1], total[-1, :-1], total[:-1, :-1], reg)

    def predicted(batches):
        for batch in batches:
            guess = fourier(batch) @ beta + intercept + centre
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(guess)], [*batch.schema.names, "prediction"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in test.schema)
    return test.mapInArrow(predicted, schema + ", prediction double")


# --- L3-L6, L12: votes and means over exact nearest neighbours -----------------------------

def vote(nbs: DataFrame, k: int) -> DataFrame:
    """L3: majority label of the ``k`` nearest; a tie goes to the smallest label."""
    votes = (nbs.where(F.col("nb_rank") <= k).groupBy("qid", "qrow", "label")
             .agg(F.count(F.lit(1)).alias("votes")))
    w = Window.partitionBy("qrow").orderBy(F.desc("votes"), F.asc("label"))
    return (votes.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1)
            .select("qid", F.col("label").alias("predicted")))


def knn_mean(nbs: DataFrame, k: int) -> DataFrame:
    """Mean label of the ``k`` nearest of every query row, beside its true label."""
    return (nbs.where(F.col("nb_rank") <= k).groupBy("qid", "qrow")
            .agg(F.avg("label").alias("prediction"), F.first("truth").alias("label")))


def accuracy_by_k(nbs: DataFrame, ks=range(1, 10)) -> DataFrame:
    """L4: accuracy of the majority vote for each k, in one pass over one
    neighbour table holding the max(k) nearest (with the queries' true labels): a neighbour of rank r votes
    for every k >= r, the winner per (test row, k) is the most voted label
    (smallest on a tie), and one aggregate gives all accuracies."""
    ks = sorted(ks)
    per_k = nbs.where(F.col("nb_rank") <= ks[-1]).withColumn(
        "k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]),
                                lambda k: k >= F.col("nb_rank"))))
    votes = per_k.groupBy("qrow", "k", "truth", "label").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("qrow", "k").orderBy(F.desc("votes"), F.asc("label"))
    winners = votes.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1)
    return winners.groupBy("k").agg(F.avg((F.col("label") == F.col("truth")).cast("double")).alias("accuracy"))
