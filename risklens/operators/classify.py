"""Supervised classification and its evaluation (ML1-ML12, AG21, PF19).

Each classifier is a four-stage ``Pipeline``: label indexer and vector
indexer (both fitted on the union data set, so no unseen category can occur),
the estimator on the indexed columns, and the index-to-label converter.
Metrics are one aggregate pass with conditional counts.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens import defaults as D
from risklens.operators.trees import tree_checks

SEED = 42

# The classifier settings of the six jobs.
ESTIMATORS = {
    "decision_tree": (DecisionTreeClassifier, {"minInstancesPerNode": 10}),
    "random_forest": (RandomForestClassifier, {"numTrees": 50, "maxDepth": 7,
                                               "featureSubsetStrategy": "sqrt",
                                               "subsamplingRate": 0.3}),
    "gbt": (GBTClassifier, {"maxIter": 10, "maxDepth": 7}),
    "logistic": (LogisticRegression, {"maxIter": 1000, "regParam": 0.01}),
    "lasso": (LogisticRegression, {"maxIter": 1000, "regParam": 0.01, "elasticNetParam": 1.0}),
    "ridge": (LogisticRegression, {"maxIter": 1000, "regParam": 0.01, "elasticNetParam": 0.0}),
}


def build_pipeline(all_data: DataFrame, kind: str,
                   max_categories: int = D.VECTOR_MAX_CATEGORIES,
                   **params) -> Pipeline:
    """ML1-ML4: indexers fitted on ``all_data``, then ``kind``'s estimator."""
    if kind not in ESTIMATORS:
        raise ValueError(f"unknown classifier {kind!r}; one of {sorted(ESTIMATORS)}")
    cls, defaults = ESTIMATORS[kind]
    settings = {**defaults, **params}
    if cls is not LogisticRegression:
        settings.setdefault("seed", SEED)
    label_idx = StringIndexer(inputCol="label", outputCol="indexedLabel").fit(all_data)
    feat_idx = VectorIndexer(inputCol="features", outputCol="indexedFeatures",
                             maxCategories=max_categories).fit(all_data)
    est = cls(labelCol="indexedLabel", featuresCol="indexedFeatures", **settings)
    to_label = IndexToString(inputCol="prediction", outputCol="predictedLabel",
                             labels=label_idx.labels)
    return Pipeline(stages=[label_idx, feat_idx, est, to_label])


def train(train_df: DataFrame, all_data: DataFrame, kind: str, **params) -> PipelineModel:
    """ML4-ML10: fit the pipeline on the training set."""
    return build_pipeline(all_data, kind, **params).fit(train_df)


def precision_recall(pred: DataFrame, label: str = "label",
                     prediction: str = "predictedLabel", positive: float = 1.0) -> DataFrame:
    """AG21 / ML11: one pass -> (n, n_true, n_pred, n_right, precision,
    recall, accuracy); precision is NULL without positive predictions."""
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    m = pred.agg(F.count("*").alias("n"),
                 F.count_if(y == positive).alias("n_true"),
                 F.count_if(p == positive).alias("n_pred"),
                 F.count_if((p == y) & (y == positive)).alias("n_right"),
                 F.count_if(p == y).alias("n_correct"))
    return m.select("n", "n_true", "n_pred", "n_right",
                    F.try_divide(F.col("n_right").cast("double"), F.col("n_pred")).alias("precision"),
                    F.try_divide(F.col("n_right").cast("double"), F.col("n_true")).alias("recall"),
                    F.try_divide(F.col("n_correct").cast("double"), F.col("n")).alias("accuracy"))


def train_and_score(train_df: DataFrame, test_df: DataFrame, all_data: DataFrame,
                    kind: str, model: PipelineModel | None = None, **params) -> DataFrame:
    """CJ9: fit on train, score train and test -> metrics per set; ``model``:
    the fit, where it is made already."""
    if model is None:
        model = train(train_df, all_data, kind, **params)
    parts = [precision_recall(model.transform(d)).select(F.lit(name).alias("dataset"), "*")
             for name, d in (("train", train_df), ("test", test_df))]
    return parts[0].unionByName(parts[1]).withColumn("model", F.lit(kind))


def positive_index(model: PipelineModel, positive: float = 1.0) -> int:
    """Index of the positive label in the fitted indexer (most frequent label first)."""
    return [float(x) for x in model.stages[0].labels].index(positive)


def threshold(pred: DataFrame, t: float, index: int, prob_col: str = "probability",
              out: str = "thresholdLabel") -> DataFrame:
    """PF19: positive when the probability at ``index`` (of the positive label,
    see ``positive_index``) exceeds ``t``."""
    p1 = vector_to_array(F.col(prob_col))[index]
    return pred.withColumn(out, F.when(p1 > t, F.lit(1.0)).otherwise(F.lit(0.0)))


# ---- what a fit must satisfy, checked on its own training rows

def stationarity(model: PipelineModel, train_df: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """ML8-ML10: ``(item, ok)`` per feature and for the intercept: whether the
    (sub)gradient of the regularised log-loss is zero there, within the tolerance.

    Spark penalises coefficients of features scaled to unit deviation, so with
    g the mean of (p - y) x / sd and w = coefficient * sd: g + reg (1 - a) w
    + reg a sign(w) = 0, or |g| <= reg a where w = 0 (a: elastic-net share).
    One aggregate by feature over the training rows.
    """
    lr = model.stages[2]
    reg, a = lr.getRegParam(), lr.getElasticNetParam()
    scored = model.transform(train_df).select(
        vector_to_array("indexedFeatures").alias("x"), F.col("indexedLabel").alias("y"),
        vector_to_array("probability")[1].alias("p"))
    weights = F.map_from_arrays(F.array(*[F.lit(j) for j in range(len(lr.coefficients))]),
                                F.array(*[F.lit(float(c)) for c in lr.coefficients]))
    error = F.col("p") - F.col("y")
    per_feature = (scored.select(F.posexplode("x").alias("j", "v"), error.alias("e")).groupBy("j")
                   .agg(F.avg(F.col("e") * F.col("v")).alias("g"), F.stddev_samp("v").alias("s")))
    w, g = weights[F.col("j")] * F.col("s"), F.try_divide(F.col("g"), F.col("s"))
    off = F.when(w == 0, F.greatest(F.abs(g) - reg * a, F.lit(0.0))).otherwise(F.abs(g + reg * (1 - a) * w + reg * a * F.signum(w)))
    features = per_feature.select(F.concat(F.lit("feature "), F.col("j").cast("string")).alias("item"),
                                  F.coalesce(off <= tolerance, F.lit(True)).alias("ok"))
    intercept = scored.agg(F.avg(error).alias("g")).select(F.lit("intercept").alias("item"), (F.abs("g") <= tolerance).alias("ok"))
    return intercept.unionByName(features)


def leaf_majorities(model: PipelineModel, train_df: DataFrame) -> DataFrame:
    """ML5: one row ``(item, ok)``: whether the tree predicts, in every leaf, a class
    that no other class outnumbers among the training rows routed to it."""
    scored = model.transform(train_df)
    leaves = (scored.withColumn("leaf", F.col("rawPrediction").cast("string"))
              .groupBy("leaf", "prediction")
              .agg(F.count_if(F.col("indexedLabel") == F.col("prediction")).alias("own"), F.count("*").alias("n")))
    return leaves.agg(F.coalesce(F.bool_and(2 * F.col("own") >= F.col("n")), F.lit(True)).alias("ok")).select(
        F.lit("leaves").alias("item"), "ok")


def ensemble_votes(model: PipelineModel, df: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """ML6, ML7: one row ``(item, ok)``: whether the ensemble's raw scores are the
    (weighted) sums of its trees' own predictions, and its class follows from them."""
    ensemble = model.stages[2]
    gbt = not hasattr(ensemble, "getNumTrees") or ensemble.__class__.__name__.startswith("GBT")
    out = model.transform(df).withColumn("margin", F.lit(0.0))
    for tree, weight in zip(ensemble.trees, ensemble.treeWeights):
        part = tree.copy({tree.predictionCol: "tree_prediction"})
        if not gbt:
            part.setProbabilityCol("tree_probability").setRawPredictionCol("tree_raw")
        out = part.transform(out)
        vote = F.col("tree_prediction") if gbt else vector_to_array("tree_probability")[1]
        out = out.withColumn("margin", F.col("margin") + F.lit(float(weight)) * vote).drop(
            "tree_prediction", "tree_probability", "tree_raw")
    raw = vector_to_array("rawPrediction")
    same = F.abs(raw[1] - F.col("margin")) <= tolerance * (1 + F.abs("margin"))
    follows = (F.col("prediction") == 1.0) == (raw[1] > raw[0])
    return out.agg(F.coalesce(F.bool_and(same & (follows | (raw[0] == raw[1]))), F.lit(True)).alias("ok")).select(
        F.lit("votes").alias("item"), "ok")


def fit_checks(model: PipelineModel, train_df: DataFrame, kind: str) -> DataFrame:
    """``(item, ok)`` rows of the checks that apply to ``kind``."""
    if kind == "decision_tree":
        return tree_checks(model.stages[2], model.transform(train_df), model.stages[2].getMinInstancesPerNode())
    if kind in ("random_forest", "gbt"):
        return ensemble_votes(model, train_df)
    return stationarity(model, train_df)
