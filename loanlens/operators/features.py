"""Feature operators: encodings, standardisation, risk proxies, cross-dataset harmonisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import clip, safe_divide
from .scorecard import fit_zscore


def one_hot(df: DataFrame, col: str, prefix: str | None = None) -> DataFrame:
    """All-levels one-hot in sorted level order; unknown/null -> all zeros.

    StringIndexer(keep) puts unseen/null at the last index and OneHotEncoder(dropLast=True)
    drops exactly that slot, so invalid values become the zero vector.
    """
    prefix = prefix or col
    idx = StringIndexer(inputCol=col, outputCol=f"_{col}_idx", handleInvalid="keep", stringOrderType="alphabetAsc")
    enc = OneHotEncoder(inputCol=f"_{col}_idx", outputCol=f"_{col}_vec", dropLast=True, handleInvalid="keep")
    model = Pipeline(stages=[idx, enc]).fit(df)
    labels = model.stages[0].labels
    out = model.transform(df).withColumn("_arr", vector_to_array(f"_{col}_vec"))
    cols = [F.col("_arr")[i].alias(f"{prefix}_{lab}") for i, lab in enumerate(labels)]
    return out.select(*[c for c in df.columns], *cols)


def zscore_columns(df: DataFrame, cols: Sequence[str], ddof: int = 1, eps: float = K.ZSCORE_EPS,
                   prefix: str = "z_") -> DataFrame:
    """(x - mean) / (std + eps), std with ddof=1 (pandas) or ddof=0 (sklearn scaler, eps=0)."""
    stats = fit_zscore(df, cols, ddof)
    out = df
    for c in cols:
        m, s = stats[c]
        out = out.withColumn(f"{prefix}{c}", (F.col(c) - F.lit(m)) / (F.lit(s if s is not None else 0.0) + F.lit(eps)))
    return out


def standardise(df: DataFrame, cols: Sequence[str], with_mean: bool = True, prefix: str = "s_") -> DataFrame:
    """sklearn StandardScaler semantics: population std; a zero std leaves values unscaled."""
    stats = fit_zscore(df, cols, ddof=0)
    out = df
    for c in cols:
        m, s = stats[c]
        scale = s if s not in (None, 0.0) else 1.0
        centred = F.col(c) - F.lit(m) if with_mean else F.col(c)
        out = out.withColumn(f"{prefix}{c}", centred / F.lit(scale))
    return out


def risk_proxy_msme(util="revolving_utilization", emi="emi_delay_count", l90="late_90_days",
                    hist="payment_history_score"):
    u, e, l, h = F.col(util), F.col(emi), F.col(l90), F.col(hist)
    raw = (0.35 * u + 0.30 * F.least(e / 4.0, F.lit(1.0)) + 0.25 * F.least(l.cast("double"), F.lit(2.0)) / 2.0
           + 0.10 * (1 - h))
    return clip(raw, 0.0, 1.0)


def risk_proxy_consumer(grade="loan_grade_ord", pct="loan_percent_income", rate="loan_int_rate", flag="default_flag"):
    g, p, r, f = F.col(grade), F.col(pct), F.col(rate), F.col(flag)
    raw = 0.30 * g / 7.0 + 0.30 * F.least(p / 0.5, F.lit(1.0)) + 0.25 * (r - 7) / 15.0 + 0.15 * f
    return clip(raw, 0.0, 1.0)


def harmonise_loans(df: DataFrame, dti_median: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Map an out-of-domain loan table onto the sixteen scorecard features; ``keep`` columns go along, such as a label."""
    if dti_median is None:
        from .ordered import exact_medians
        dti_median = exact_medians(df, ["debt_to_income"])["debt_to_income"]
    used, limit = F.col("total_credit_utilized"), F.col("total_credit_limit")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.select(
        "order_id", "line_no", *keep,
        F.coalesce(clip(safe_divide(used, limit), 0.0, 5.0), F.lit(0.0)).alias("revolving_utilization"),
        F.coalesce(F.col("debt_to_income"), F.lit(dti_median)).alias("debt_ratio"),
        z("delinq_2y").alias("late_30_59"),
        z("num_accounts_30d_past_due").alias("late_60_89"),
        z("num_historical_failed_to_pay").alias("late_90_days"),
        z("open_credit_lines").alias("open_credit_lines"),
        z("num_mort_accounts").alias("real_estate_loans"),
        F.lit(0).alias("num_dependents"),
        F.coalesce(clip(F.col("annual_income") / 200000.0, 0.0, 1.0), F.lit(0.0)).alias("income_stability"),
        clip(1 - z("delinq_2y") * 0.1, 0.0, 1.0).alias("gst_compliance_score"),
        z("num_accounts_30d_past_due").alias("emi_delay_count"),
        clip(F.coalesce(F.col("debt_to_income"), F.lit(0.0)) / 50.0, 0.0, 5.0).alias("cashflow_stress_ratio"),
        F.coalesce(clip(safe_divide(used, limit), 0.0, 1.0), F.lit(0.0)).alias("working_capital_usage"),
        clip(1 - F.coalesce(F.col("interest_rate"), F.lit(10.0)) / 35.0, 0.2, 2.0).alias("revenue_trend_index"),
        clip(F.coalesce(F.col("account_never_delinq_percent"), F.lit(100.0)) / 100.0, 0.0, 1.0)
        .alias("payment_history_score"),
        (z("num_historical_failed_to_pay") > 0).cast("double").alias("supplier_payment_risk"),
    )
