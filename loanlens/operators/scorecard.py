"""Closed-form z-score scorecard: standardise, weight, add intercept, sigmoid.

Fitting collects a bounded handful of numbers (mean/std per feature, or one aggregate row
per intercept pass) — the same pattern as ``spark.ml`` estimators — and applying them is a
pure projection that stays inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import sigmoid


def fit_zscore(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation (ddof=1 like pandas, ddof=0 like sklearn) in one pass."""
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), sd(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def zscore(col: str, stats: Mapping[str, tuple[float, float]], eps: float = K.ZSCORE_EPS) -> Column:
    mean, std = stats[col]
    return (F.col(col) - F.lit(mean)) / (F.lit(std if std is not None else 0.0) + F.lit(eps))


def margin(stats: Mapping[str, tuple[float, float]], weights: Mapping[str, float] = K.SCORECARD_WEIGHTS,
           intercept: float = 0.0, eps: float = K.ZSCORE_EPS) -> Column:
    """Linear predictor: sum_i w_i * z_i + intercept (features in weight order)."""
    out = None
    for c, w in weights.items():
        term = F.lit(w) * zscore(c, stats, eps)
        out = term if out is None else out + term
    return out + F.lit(intercept)


def score(df: DataFrame, stats: Mapping[str, tuple[float, float]] | None = None,
          weights: Mapping[str, float] = K.SCORECARD_WEIGHTS, intercept: float = K.FIXTURE_INTERCEPT,
          pd_col: str = "pd") -> DataFrame:
    """Append the scorecard probability of default."""
    stats = stats or fit_zscore(df, list(weights))
    return df.withColumn("margin", margin(stats, weights, intercept)).withColumn(pd_col, sigmoid(F.col("margin")))


def fit_intercept(df: DataFrame, stats: Mapping[str, tuple[float, float]] | None = None,
                  weights: Mapping[str, float] = K.SCORECARD_WEIGHTS, target_rate: float = K.SCORECARD_TARGET_RATE,
                  lo: float = K.SCORECARD_INTERCEPT_RANGE[0], hi: float = K.SCORECARD_INTERCEPT_RANGE[1],
                  grid: int = 41, passes: int = 4) -> float:
    """Intercept b with mean(sigmoid(margin + b)) closest to ``target_rate``.

    The mean rate is increasing in b. Each pass evaluates ``grid`` candidates in ONE
    aggregate (41 avg columns over one scan), then narrows to the bracketing interval.
    """
    stats = stats or fit_zscore(df, list(weights))
    m = df.select(margin(stats, weights, 0.0).alias("_m"))
    for _ in range(passes):
        step = (hi - lo) / (grid - 1)
        cands = [lo + i * step for i in range(grid)]
        row = m.agg(*[F.avg(sigmoid(F.col("_m") + F.lit(b))).alias(f"r{i}") for i, b in enumerate(cands)]).first()
        rates = [row[f"r{i}"] for i in range(grid)]
        above = [i for i, r in enumerate(rates) if r is not None and r >= target_rate]
        j = above[0] if above else grid - 1
        lo, hi = cands[max(j - 1, 0)], cands[j]
    return (lo + hi) / 2.0


@dataclass(frozen=True)
class InterceptFit:
    intercept: float
    error: float  # bound of the difference between the achieved and the target rate
    bins: int


def fit_intercept_histogram(df: DataFrame, stats: Mapping[str, tuple[float, float]] | None = None, weights: Mapping[str, float] = K.SCORECARD_WEIGHTS,
                            target_rate: float = K.SCORECARD_TARGET_RATE, lo: float = K.SCORECARD_INTERCEPT_RANGE[0], hi: float = K.SCORECARD_INTERCEPT_RANGE[1],
                            width: float = 0.01) -> InterceptFit:
    """Intercept b with mean(sigmoid(margin + b)) = ``target_rate`` from ONE pass over the rows.

    The pass makes a histogram of margins, (bin, count, sum) by bins of ``width``; tasks' histograms merge by adding. Margins
    where sigmoid(margin + b) is 0 or 1 to the last digit for every b in range share the edge bins, so there are at most
    (hi - lo + 80) / width bins whatever the data. Bisection then runs over the bins' mean margins: within a bin the
    sigmoid differs from its value at the mean by at most max|sigmoid''| * width^2 / 8, which bounds the error."""
    stats = stats or fit_zscore(df, list(weights))
    m = F.col("_m")
    edge_lo, edge_hi = -hi - 40.0, -lo + 40.0
    bounded = df.select(margin(stats, weights, 0.0).alias("_m")).where(m.isNotNull()).select(F.greatest(F.lit(edge_lo), F.least(m, F.lit(edge_hi))).alias("_m"))
    bins = [(r["n"], r["s"] / r["n"]) for r in bounded.groupBy(F.floor(m / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("_m").alias("s")).collect()]
    total = sum(n for n, _ in bins)

    def rate(b: float) -> float:
        return sum(n / (1.0 + math.exp(-(x + b))) for n, x in bins) / total

    while total and hi - lo > 1e-10:
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if rate(mid) >= target_rate else (mid, hi)
    return InterceptFit((lo + hi) / 2, width * width / (8 * 6 * math.sqrt(3)) + 1e-9, len(bins))
