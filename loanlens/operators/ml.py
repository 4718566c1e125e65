"""Model training and scoring on spark.ml: exact-median imputation, stratified split and
folds, boosted trees, logistic regression, random forest, isotonic calibration.

Splits and folds are exact per-class quotas: each class is ranked by a deterministic order
key (a seeded hash in production, the id for reproducible checks) with running counts over
value ranges (no single-partition window even when one class holds most rows).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .imputer import ExactMedianImputer
from .ordered import running_totals


TRAINING_ROWS = 250_000  # a task of a fit: some 110 MB of cached rows with the consumer model's features


def order_key(df: DataFrame, key: str, seed: int | None) -> DataFrame:
    """Deterministic rank key: a seeded 64-bit hash of the id, or without a seed a numeric id itself."""
    k = F.xxhash64(F.col(key), F.lit(0 if seed is None else seed))
    return df.withColumn("_ord", k if seed is not None or isinstance(df.schema[key].dataType, StringType) else F.col(key))


def class_ranks(df: DataFrame, label: str, key: str, seed: int | None = None) -> DataFrame:
    ranked = running_totals(order_key(df, key, seed).withColumn("_one", F.lit(1)), "_ord", ["_one"], [label], tie_cols=[key])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_class_n"))
    return ranked.join(sizes, label).withColumnRenamed("cum__one", "_rank").drop("_one", "_ord")


def stratified_split(df: DataFrame, label: str, key: str, test_frac: float = 0.2, seed: int | None = None) -> DataFrame:
    """Exact per-class hold-out: the first round(n_class * test_frac) rows of each class
    (in order-key order) are 'test', the rest 'train'."""
    r = class_ranks(df, label, key, seed)
    quota = F.floor(F.col("_class_n") * test_frac + 0.5)
    return r.withColumn("split", F.when(F.col("_rank") <= quota, F.lit("test")).otherwise(F.lit("train"))) \
        .drop("_rank", "_class_n")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int | None = None) -> DataFrame:
    """Fold id (rank within class - 1) mod k: class-balanced folds."""
    r = class_ranks(df, label, key, seed)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_class_n")


def preprocessing(features: Sequence[str]) -> list:
    """Pipeline stages before a model: exact medians fitted on the training rows fill nulls, then the
    vector. They are saved with the model and refitted in each fold."""
    filled = [f"filled_{f}" for f in features]
    return [ExactMedianImputer(inputCols=list(features), outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="error")]


def filled(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with the features as the model sees them."""
    out = model.stages[0].transform(df)
    return out.drop(*features).withColumnsRenamed({f"filled_{f}": f for f in features})


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2 * n_class) as a column (fitted counts are two numbers)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    w = {c: n / (2.0 * m) for c, m in counts.items() if m}
    expr = None
    for c, v in w.items():
        expr = F.when(F.col(label) == c, F.lit(v)) if expr is None else expr.when(F.col(label) == c, F.lit(v))
    return df.withColumn("weight", expr.otherwise(F.lit(1.0)) if expr is not None else F.lit(1.0))


def training_frame(train: DataFrame, label: str) -> DataFrame:
    """Iterative fits read their input many times: write it once (class weights included) to the
    checkpoint folder so every pass reads files instead of recomputing the upstream plan. No task of the
    fit gets much more than ``TRAINING_ROWS`` rows."""
    from .ordered import checkpointed
    frame = checkpointed(with_class_weight(train, label))
    # a file's rows take many times its bytes in the memory of the fit, so files are dealt out by rows
    parts = math.ceil(frame.count() / TRAINING_ROWS)
    return frame.repartition(parts) if parts > frame.rdd.getNumPartitions() else frame


def fit_gbt(train: DataFrame, features: Sequence[str], label: str, max_iter: int = 50, depth: int = 5,
            step: float = 0.05, subsample: float = 0.8, seed: int = 42) -> PipelineModel:
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=max_iter, maxDepth=depth,
                        stepSize=step, subsamplingRate=subsample, seed=seed)
    return Pipeline(stages=[*preprocessing(features), gbt]).fit(training_frame(train, label))


def fit_random_forest(train: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 6,
                      seed: int = 42) -> PipelineModel:
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees,
                                maxDepth=depth, seed=seed)
    return Pipeline(stages=[*preprocessing(features), rf]).fit(training_frame(train, label))


def fit_logreg(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Class-balanced L2 logistic regression (sklearn C=1 corresponds to regParam = 1 / n)."""
    n = train.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1.0 / max(n, 1),
                            elasticNetParam=0.0, standardization=True, maxIter=200)
    return Pipeline(stages=[*preprocessing(features), lr]).fit(training_frame(train, label))


def score_model(model: PipelineModel, df: DataFrame, name: str = "prob") -> DataFrame:
    out = model.transform(df)
    gone = [c for c in out.columns if c.startswith("filled_")]
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", *gone)


def calibrate(cal: DataFrame, prob: str, label: str):
    """Isotonic calibration (increasing); predictions outside the fitted range take the edge value."""
    points = (cal.where(F.col(prob).isNotNull()).groupBy(prob).agg(F.avg(F.col(label).cast("double")).alias(label), F.count(F.lit(1)).cast("double").alias("_w")))
    return IsotonicRegression(featuresCol=prob, labelCol=label, weightCol="_w", predictionCol="prob_calibrated",
                              isotonic=True).fit(points)
