"""Parameter search for boosted trees by successive halving.

Every trial is one joint draw of all parameters that Spark's boosted trees have. The folds are the resource: the
first rung scores all trials on one fold, each further rung the better part of them on one fold more, and the last
rung on all folds, so most of the time goes to trials worth it. Preprocessing (medians) is fitted in each fold on its own
training rows, once, and its vectors are written; trials of a rung run side by side.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from .ml import preprocessing
from .ordered import checkpointed

# The search space: ("int", low, high, step), ("float", low, high) or ("log", low, high). Ranges of trees, depth, learning
# rate, row and column sampling and smallest leaf are fixed values; ``min_gain`` is the least impurity gain of a split.
# ``positive_weight`` is drawn between 1 and 1.5 times the ratio of the classes.
SPACE: dict[str, tuple] = {
    "trees": ("int", 200, 800, 50),
    "depth": ("int", 3, 9, 1),
    "step_size": ("log", 0.01, 0.3),
    "row_share": ("float", 0.6, 1.0),
    "column_share": ("float", 0.5, 1.0),
    "leaf_rows": ("int", 1, 12, 1),
    "min_gain": ("float", 0.0, 0.01),
    "positive_weight": ("float", 1.0, None),
}
TRIALS = 40
FOLDS = 5
WEIGHT_CEILING = 1.5


def draw(space: Mapping[str, tuple], trials: int, class_ratio: float, seed: int = 42) -> list[dict]:
    """``trials`` independent joint draws, a pure function of the seed."""
    rng, out = random.Random(seed), []
    for _ in range(trials):
        one = {}
        for name, (kind, low, high, *step) in space.items():
            high = max(low, WEIGHT_CEILING * class_ratio) if high is None else high
            if kind == "int":
                one[name] = low + step[0] * rng.randint(0, (high - low) // step[0])
            elif kind == "log":
                one[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                one[name] = rng.uniform(low, high)
        out.append(one)
    return out


def rungs(trials: int, folds: int, keep: float = 0.5) -> list[tuple[int, int]]:
    """(trials, folds) of each rung: one fold more each time, the share ``keep`` of the trials stays."""
    out, n = [], trials
    for k in range(1, folds + 1):
        out.append((n, k))
        n = max(1, math.ceil(n * keep))
    return out


@dataclass
class _Fold:
    train: DataFrame
    test: DataFrame


def _folds(df: DataFrame, features: Sequence[str], label: str, fold_col: str, folds: int) -> list[_Fold]:
    out = []
    for k in range(folds):
        inside = df.where(F.col(fold_col) != k)
        stages = Pipeline(stages=preprocessing(features)).fit(inside)
        ready = lambda part: checkpointed(stages.transform(part).select(F.col(label).cast("double").alias(label), "features"))  # noqa: E731, B023
        out.append(_Fold(ready(inside), ready(df.where(F.col(fold_col) == k))))
    return out


def _auc(fold: _Fold, p: dict, label: str, seed: int) -> float:
    train = fold.train.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(p["positive_weight"]))).otherwise(F.lit(1.0)))
    gbt = GBTClassifier(labelCol=label, weightCol="weight", maxIter=p["trees"], maxDepth=p["depth"], stepSize=p["step_size"], subsamplingRate=p["row_share"],
                        featureSubsetStrategy=str(p["column_share"]), minInstancesPerNode=p["leaf_rows"], minInfoGain=p["min_gain"], seed=seed)
    scored = gbt.fit(train).transform(fold.test)
    return BinaryClassificationEvaluator(labelCol=label, numBins=0).evaluate(scored)


def successive_halving(df: DataFrame, features: Sequence[str], label: str, fold_col: str = "fold", folds: int = FOLDS, trials: int = TRIALS,
                       space: Mapping[str, tuple] = SPACE, keep: float = 0.5, parallelism: int = 4, seed: int = 42) -> DataFrame:
    """One row per rung and trial: rung, trial, folds, the drawn parameters, ``cv_auc`` (mean over the folds so far) and
    ``promoted`` (goes on to the next rung; in the last one: is the best). Ties go to the smaller trial number."""
    spark = df.sparkSession
    n = df.groupBy(label).count().collect()  # two rows
    size = {int(r[label]): r["count"] for r in n}
    draws = draw(space, trials, size.get(0, 0) / max(size.get(1, 0), 1), seed)
    parts = _folds(df, features, label, fold_col, folds)
    seen: dict[int, list[float]] = {t: [] for t in range(trials)}
    alive, rows, plan = list(range(trials)), [], rungs(trials, folds, keep)
    with ThreadPool(max(1, min(parallelism, trials))) as pool:
        for r, (_, k) in enumerate(plan):
            run = inheritable_thread_target(spark)(lambda t: _auc(parts[k - 1], draws[t], label, seed))  # noqa: B023
            for t, auc in zip(alive, pool.map(run, alive)):
                seen[t].append(auc)
            mean = {t: sum(seen[t]) / len(seen[t]) for t in alive}
            ranked = sorted(alive, key=lambda t: (-mean[t], t))  # noqa: B023
            going = set(ranked[:plan[r + 1][0] if r + 1 < len(plan) else 1])
            rows += [(r + 1, t, k, *draws[t].values(), mean[t], t in going) for t in alive]
            alive = sorted(going)
    kinds = ", ".join(f"{name} {'int' if spec[0] == 'int' else 'double'}" for name, spec in space.items())
    return spark.createDataFrame(rows, f"rung int, trial int, folds int, {kinds}, cv_auc double, promoted boolean")
