"""Registered statistics and model queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.catalog.base import query
from quarry.catalog.catalogue import SIDES
from quarry.operators.neighbours import neighbours
from quarry.plans import clean as cl
from quarry.plans import models as ml
from quarry.plans import stats as st
from quarry.plans import trees
from quarry.session import cut_lineage
from quarry.sources import tables as tb

MATRIX_1 = ["price", "discount", "depth", "height", "width", "v_furniture",
            "other_category_le", "other_colors_le"]
SIDE_AREAS = ["price", "s1", "s2", "s3"]  # side areas, chosen at 0.5
MATRIX_2 = ["price", "depth", "height", "width", "v_furniture", "s3", "s2", "s1"]
DIM = 64


def prepared(spark, sf, codes: bool = False) -> DataFrame:
    """Items after cleaning, median imputation and geometry; with label ``codes`` where a query reads them.
    Imputation runs before the label codes (they touch different columns, so
    the result is the same) to keep the code joins out of its boundary pass."""
    items = cl.discounts(cl.clean_old_price(tb.items(spark, sf)))
    items = cl.impute_group_median(items, "category", SIDES)
    if codes:
        items = cl.label_encode(items, {"other_colors": "other_colors_le",
                                        "category": "other_category_le"})
    return cl.add_geometry(items)


def split_items(spark, sf) -> DataFrame:
    return ml.hash_split(ml.ml_frame(prepared(spark, sf)), "item_id")


def embeddings(spark, sf) -> DataFrame:
    e = tb.table(spark, sf, "embeddings")
    return ml.hash_split(e.select(F.col("vec_id").alias("id"),
                                  F.col("embedding").cast("array<double>").alias("vec"),
                                  F.col("label").cast("double").alias("label")), "id")


def _emb_neighbours(spark, sf, k):
    e = embeddings(spark, sf)
    train = e.where(F.col("split") == "train").select("id", "vec", "label")
    return neighbours(train, e.where(F.col("split") == "test").select("id", "vec", F.col("label").alias("truth")), k)


# --- statistics -------------------------------------------------------------------------

@query("shapiro_wilk")
def q_shapiro_wilk(spark, sf):
    return st.shapiro_wilk(tb.items(spark, sf), "price")


@query("ks_normal")
def q_ks_normal(spark, sf):
    return st.kolmogorov_smirnov(tb.items(spark, sf), "price")


@query("mann_whitney_u")
def q_mann_whitney_u(spark, sf):
    return st.mann_whitney_u(tb.items(spark, sf), "price", "other_colors", "No", "Yes")


@query("pearson")
def q_pearson(spark, sf):
    return st.pearson(prepared(spark, sf), "price", "v_furniture")


@query("spearman_matrix")
def q_spearman_matrix(spark, sf):
    return st.spearman_matrix(prepared(spark, sf, codes=True), MATRIX_1)


@query("feature_selection")
def q_feature_selection(spark, sf):
    return st.feature_selection(st.spearman_matrix(prepared(spark, sf), MATRIX_2), "price", 0.3)


@query("feature_selection_sides")
def q_feature_selection_sides(spark, sf):
    return st.feature_selection(st.spearman_matrix(prepared(spark, sf), SIDE_AREAS), "price", 0.5)


@query("test_decision")
def q_test_decision(spark, sf):
    items = tb.items(spark, sf)
    sw = st.decide(st.shapiro_wilk(items, "price"), "shapiro_wilk", 0.01, "w")
    mw = st.decide(st.two_sided_p(st.mann_whitney_u(items, "price", "other_colors", "No", "Yes")),
                   "mann_whitney_u", 0.05, "u1")
    return sw.unionByName(mw)


# --- models ---------------------------------------------------------------------------------

@query("features")
def q_features(spark, sf):
    return ml.ml_frame(prepared(spark, sf))


@query("hash_split")
def q_hash_split(spark, sf):
    return split_items(spark, sf).select("item_id", "split")


@query("knn_classify")
def q_knn_classify(spark, sf):
    return ml.vote(_emb_neighbours(spark, sf, 3), 3)


@query("knn_accuracy_by_k")
def q_knn_accuracy_by_k(spark, sf):
    return ml.accuracy_by_k(_emb_neighbours(spark, sf, 9), range(1, 10))


@query("knn_predict_one")
def q_knn_predict_one(spark, sf):
    """k=1 prediction for one new point: the centroid of all embeddings."""
    e = embeddings(spark, sf)
    centroid = e.agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(DIM)]).alias("vec"))
    new = centroid.select(F.lit(0).cast("bigint").alias("id"), "vec")
    train = e.where(F.col("split") == "train").select("id", "vec", "label")
    return ml.vote(neighbours(train, new, 1), 1)


@query("knn_train_accuracy")
def q_knn_train_accuracy(spark, sf):
    e = embeddings(spark, sf).where(F.col("split") == "train")
    nbs = neighbours(e.select("id", "vec", "label"), e.select("id", "vec", F.col("label").alias("truth")), 1)
    return ml.accuracy_by_k(nbs, [1]).select("accuracy")


def _item_vectors(split: DataFrame) -> DataFrame:
    """Features in hundredths, as whole numbers: distances are exact and their ties too."""
    return split.select(F.col("item_id").alias("id"),
                        F.array(*[F.round(F.col(c) * 100) for c in ml.FEATURES]).alias("vec"),
                        F.col("label").cast("double").alias("label"), "split")


def knn_regression(split: DataFrame) -> DataFrame:
    data = _item_vectors(split)
    test = data.where(F.col("split") == "test").select("id", "vec", F.col("label").alias("truth"))
    return ml.knn_mean(neighbours(data.where(F.col("split") == "train"), test, 5), 5)


@query("knn_regress")
def q_knn_regress(spark, sf):
    return ml.metrics(knn_regression(split_items(spark, sf)), "knn")


FITS = {
    "linear": lambda split: ml.least_squares(split),
    "tree": lambda split: trees.fit_predict(split, ml.FEATURES),
    "forest": lambda split: trees.fit_predict(split, ml.FEATURES, trees=100, bootstrap=True),
    "gbt": lambda split: ml.fit_predict(split, "gbt"),
    "kernel_rff": lambda split: ml.kernel_predict(split),
    "knn": knn_regression,
}


def _model(kind):
    def run(spark, sf):
        return ml.metrics(FITS[kind](split_items(spark, sf)), kind)
    return run


for _kind, _key in (("linear", "linear_regression"), ("tree", "tree"),
                    ("forest", "forest"), ("gbt", "gbt")):
    query(_key)(_model(_kind))


@query("tree_two_levels")
def q_tree_two_levels(spark, sf):
    return ml.metrics(trees.fit_predict(split_items(spark, sf), ml.FEATURES, max_depth=2), "tree_two_levels")


@query("kernel_rff")
def q_kernel_rff(spark, sf):
    return ml.metrics(ml.kernel_predict(split_items(spark, sf)), "kernel_rff")


@query("model_comparison")
def q_model_comparison(spark, sf):
    split = cut_lineage(split_items(spark, sf))  # one split for all models

    def fitted(kind):
        return ml.metrics(FITS[kind](split), kind)

    # boosting is hundreds of short jobs on few cells, which leave most cores idle: the other fits use them
    with ThreadPoolExecutor(1) as aside:
        boosted = aside.submit(inheritable_thread_target(fitted), "gbt")
        models = {kind: fitted(kind) for kind in sorted(FITS.keys() - {"gbt", "forest"})}
        models["gbt"] = boosted.result()
    models["forest"] = fitted("forest")  # uses all cores by itself
    return reduce(DataFrame.unionByName, [models[kind] for kind in FITS]).orderBy("rmse")


@query("shapiro_wilk_w")
def q_shapiro_wilk_w(spark, sf):
    return st.shapiro_wilk(tb.items(spark, sf), "price").select("n", "w")


@query("ols_one_feature")
def q_ols_one_feature(spark, sf):
    return ml.metrics(ml.least_squares(split_items(spark, sf), ["s2"]), "linear_s2")
