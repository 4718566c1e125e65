"""Model-quality metrics over a scores table ``(model, id, y_true, prob)``, grouped by model.

Scale notes
* Threshold metrics never sort: probabilities are bucketed against the threshold grid
  (``Bucketizer``, binary search, JVM side) and counted per (model, bucket, class); the
  remaining work runs on at most models x (thresholds + 1) x 2 rows.
* Rank metrics (ROC-AUC, average precision, curves) first collapse rows to one row per
  (model, distinct score) and then take running totals per model over value ranges
  (``ordered.running_totals``) — no single-partition window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .ordered import checkpointed, running_totals

M, Y, P = "model", "y_true", "prob"


def linspace(start: float = K.SWEEP_START, stop: float = K.SWEEP_STOP, num: int = K.SWEEP_STEPS) -> list[float]:
    """numpy.linspace values (last element exactly ``stop``)."""
    return [float(v) for v in np.linspace(start, stop, num)]


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0 when b == 0 (zero_division=0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def scored_rows(scores: DataFrame) -> DataFrame:
    """Rows with a score: a row that was not scored is no prediction of either class."""
    return scores.where(F.col(P).isNotNull())


def threshold_counts(scores: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts at each threshold (predict 1 when prob >= t), per model."""
    ts = sorted(set(float(t) for t in thresholds))
    splits = [-math.inf] + ts + [math.inf]
    b = Bucketizer(splits=splits, inputCol=P, outputCol="_b", handleInvalid="keep").transform(
        scored_rows(scores).select(M, Y, F.col(P).cast("double").alias(P)))
    hist = b.groupBy(M, "_b").agg(F.count_if(F.col(Y) == 1).alias("pos"), F.count_if(F.col(Y) == 0).alias("neg"))
    # complete the (model, bucket) grid so every threshold gets a row (a bounded Generate per model)
    grid = F.array(*[F.struct(F.lit(float(i + 1)).alias("_b"), F.lit(t).alias("threshold")) for i, t in enumerate(ts)])
    models = hist.select(M).distinct().select(M, F.explode(grid).alias("g")).select(M, "g._b", "g.threshold")
    full = models.join(hist, [M, "_b"], "left").fillna(0, ["pos", "neg"])
    above = Window.partitionBy(M).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    tot = hist.groupBy(M).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # buckets below the first threshold contribute to totals only
    out = (full.select(M, "threshold", "_b", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"))
           .join(tot, M))
    return out.select(M, "threshold", (F.col("N") - F.col("fp")).alias("tn"), "fp",
                      (F.col("P") - F.col("tp")).alias("fn"), "tp")


def classification_metrics(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    precision = _div0(tp, tp + fp)
    recall = _div0(tp, tp + fn)
    f1 = _div0(2 * tp, 2 * tp + fp + fn)
    return counts.select(
        "*",
        _div0(tp + tn, n).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        _div0(tn, tn + fp).alias("specificity"),
        _div0(fn, fn + tp).alias("miss_rate"),
    )


def threshold_sweep(scores: DataFrame, grid: Sequence[float] | None = None) -> DataFrame:
    return classification_metrics(threshold_counts(scores, grid or linspace()))


def best_f1_threshold(sweep: DataFrame) -> DataFrame:
    """Threshold with the highest F1; the lowest threshold wins ties."""
    return sweep.groupBy(M).agg(
        F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")).select(
        M, F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("f1"))


def recall_floor_threshold(sweep: DataFrame, floor: float = K.RECALL_FLOOR,
                           fallback: float = K.RECALL_FLOOR_FALLBACK) -> DataFrame:
    """Highest-precision threshold with recall >= floor (lowest wins ties), else ``fallback``."""
    ok = F.col("recall") >= floor
    agg = sweep.groupBy(M).agg(
        F.max_by(F.when(ok, F.col("threshold")),
                 F.when(ok, F.struct("precision", -F.col("threshold")))).alias("t"),
        F.count_if(ok).alias("n_ok"))
    return agg.select(M, F.when(F.col("n_ok") > 0, F.col("t")).otherwise(F.lit(fallback)).alias("threshold"),
                      (F.col("n_ok") > 0).alias("recall_met"))


def score_groups(scores: DataFrame) -> DataFrame:
    """(model, prob) -> positives and negatives at that exact score."""
    return scored_rows(scores).groupBy(M, P).agg(F.count_if(F.col(Y) == 1).alias("pos"), F.count_if(F.col(Y) == 0).alias("neg"))


def ranked_groups(scores: DataFrame) -> DataFrame:
    """Per (model, distinct score): pos/neg, class totals and the counts at or above the score.

    Rows are first collapsed to distinct (model, score) and written once; running totals are
    range-split, so a model of any size is spread over tasks."""
    g = checkpointed(score_groups(scores))
    cum = running_totals(g, P, ["pos", "neg"], [M])
    tot = g.groupBy(M).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = cum.join(tot, M)  # one row per model; AQE broadcasts it after measuring it
    return j.select(M, P, "pos", "neg", "P", "N",
                    (F.col("P") - F.col("cum_pos") + F.col("pos")).alias("tp_at"),
                    (F.col("N") - F.col("cum_neg") + F.col("neg")).alias("fp_at"),
                    (F.col("cum_neg") - F.col("neg")).alias("neg_below"))


def _auc_expr():
    return (F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)) / (F.first("P") * F.first("N")))


def _ap_expr():
    prec = F.col("tp_at") / (F.col("tp_at") + F.col("fp_at"))
    return F.sum(F.col("pos") / F.col("P") * prec)


def roc_auc(scores: DataFrame) -> DataFrame:
    """Tie-aware ROC-AUC (Mann-Whitney): sum_g pos_g * (neg_below_g + neg_g / 2) / (P * N)."""
    return ranked_groups(scores).groupBy(M).agg(_auc_expr().alias("roc_auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """Step-sum average precision: sum_g (pos_g / P) * precision at threshold g."""
    return ranked_groups(scores).groupBy(M).agg(_ap_expr().alias("average_precision"))


def rank_metrics(scores: DataFrame) -> DataFrame:
    """ROC-AUC and average precision from one ranked pass."""
    return ranked_groups(scores).groupBy(M).agg(_auc_expr().alias("roc_auc"), _ap_expr().alias("average_precision"))


def roc_curve(scores: DataFrame) -> DataFrame:
    """One (fpr, tpr) point per distinct score threshold (no intermediate-point dropping)."""
    r = ranked_groups(scores)
    return r.select(M, F.col(P).alias("threshold"), (F.col("fp_at") / F.col("N")).alias("fpr"),
                    (F.col("tp_at") / F.col("P")).alias("tpr"))


def pr_curve(scores: DataFrame) -> DataFrame:
    r = ranked_groups(scores)
    return r.select(M, F.col(P).alias("threshold"),
                    (F.col("tp_at") / (F.col("tp_at") + F.col("fp_at"))).alias("precision"),
                    (F.col("tp_at") / F.col("P")).alias("recall"))


def log_loss(scores: DataFrame, eps: float = float(np.finfo(np.float64).eps)) -> DataFrame:
    p = F.least(F.greatest(F.col(P), F.lit(eps)), F.lit(1 - eps))
    y = F.col(Y).cast("double")
    return scores.groupBy(M).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def probability_losses(scores: DataFrame, eps: float = float(np.finfo(np.float64).eps)) -> DataFrame:
    """Log loss and Brier score in one aggregate."""
    p = F.least(F.greatest(F.col(P), F.lit(eps)), F.lit(1 - eps))
    y = F.col(Y).cast("double")
    return scores.groupBy(M).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
                                 F.avg(F.pow(F.col(P) - F.col(Y), 2)).alias("brier"))


def brier(scores: DataFrame) -> DataFrame:
    return scores.groupBy(M).agg(F.avg(F.pow(F.col(P) - F.col(Y), 2)).alias("brier"))


def score_histogram(scores: DataFrame, bins: int = 50) -> DataFrame:
    """Density histogram per (model, class) with the bin range taken per class."""
    scores = scored_rows(scores)
    rng = scores.groupBy(M, Y).agg(F.min(P).alias("lo0"), F.max(P).alias("hi0"), F.count(F.lit(1)).alias("n"))
    rng = rng.select(M, Y, "n",
                     F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
                     F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    j = scores.join(rng, [M, Y])  # one row per (model, class); AQE broadcasts it at runtime
    idx = F.least(F.floor((F.col(P) - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))),
                  F.lit(bins - 1)).cast("int")
    width = (F.col("hi") - F.col("lo")) / bins
    return (j.groupBy(M, Y, idx.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"), F.first("n").alias("n"), F.first("lo").alias("lo"),
                 F.first("hi").alias("hi"))
            .select(M, Y, "bin", "count",
                    (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"),
                    (F.col("count") / (F.col("n") * ((F.col("hi") - F.col("lo")) / bins))).alias("density")))


def model_comparison(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One metric row per model, plus the model with the best ROC-AUC flagged."""
    cm = classification_metrics(threshold_counts(scores, [threshold])).drop("threshold")
    table = rank_metrics(scores).join(probability_losses(scores), M).join(cm, M)
    # the table has one row per model, so a whole-table window here is tiny
    best = F.max(F.struct("roc_auc", F.col(M))).over(Window.partitionBy())[M]
    return table.withColumn("is_best", F.col(M) == best)


def ablation_lift(scores: DataFrame, base: str, full: str, places: int = 4) -> DataFrame:
    """AUC of the base and the full model and the rounded improvement."""
    auc = roc_auc(scores.where(F.col(M).isin(base, full)))
    wide = auc.groupBy().pivot(M, [base, full]).agg(F.first("roc_auc"))
    return wide.select(F.col(f"`{base}`").alias("auc_base"), F.col(f"`{full}`").alias("auc_full"),
                       F.round(F.col(f"`{full}`") - F.col(f"`{base}`"), places).alias("lift"))
