"""Monthly panel operators: snapshots, as-of rows, expanding features, running columns, events.

All per-company work is keyed by ``company_id``: a hash-partitioned aggregate or a window
partitioned by company. Nothing orders the whole panel globally. Expanding snapshots at
points 6..12 replicate each monthly row to the (at most seven) points it belongs to with
``explode(sequence(...))`` — a bounded, shuffle-free Generate — and then aggregate once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import clip

KEY, ORDER = "company_id", "month"


def latest_snapshot(df: DataFrame, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Row with the greatest ``order`` per key (one hash aggregate, no sort)."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_last")).select(key, "_last.*")


def first_snapshot(df: DataFrame, key: str = KEY, order: str = ORDER) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_first")).select(key, "_first.*")


def _safe0(a: Column, b: Column) -> Column:
    """a / b, 0.0 when b is 0 or null (the monthly-collapse helper)."""
    return F.when(b.isNull() | (b == 0), F.lit(0.0)).otherwise(a.cast("double") / b)


def monthly_collapse(df: DataFrame, key: str = KEY, order: str = ORDER) -> DataFrame:
    """One enriched snapshot per company: the last month's row plus revenue trend,
    cash-flow stress and cash-flow volatility over the observed window."""
    cols = [c for c in df.columns if c != key]
    net = F.col("monthly_inflow") - F.col("monthly_outflow")
    agg = df.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.col(order)).alias("_last"),
        F.min_by(F.col("monthly_sales"), F.col(order)).alias("_first_sales"),
        F.stddev_samp(net).alias("_vol"),
        F.count(F.lit(1)).alias("months_observed"),
    )
    last = F.col("_last")
    return agg.select(
        key, "_last.*", "months_observed",
        clip(_safe0(last["monthly_sales"], F.col("_first_sales")), 0.2, 2.0).alias("revenue_trend_index"),
        clip(_safe0(last["monthly_outflow"], last["monthly_inflow"]) * 2.0, 0.0, 5.0).alias("cashflow_stress_ratio"),
        F.when(F.col("months_observed") > 1, F.col("_vol")).otherwise(F.lit(0.0)).alias("cashflow_volatility"),
    )


def asof_snapshots(df: DataFrame, value_cols: Sequence[str], points: Sequence[int] = range(6, 13),
                   key: str = KEY, order: str = ORDER) -> DataFrame:
    """For every key and point t: values of the last observed row with ``order <= t``
    (carry-forward over missing months). Spine rows are unioned in and filled with
    ``last(..., ignorenulls)`` over a per-company window."""
    pts = F.array(*[F.lit(int(p)) for p in points])
    spine = df.select(key).distinct().select(key, F.explode(pts).alias(order)).withColumn("_spine", F.lit(1))
    obs = df.select(key, order, *value_cols).withColumn("_obs_month", F.col(order)).withColumn("_spine", F.lit(0))
    both = obs.unionByName(spine, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order, "_spine").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select(key, order, "_spine",
                         F.last("_obs_month", ignorenulls=True).over(w).alias("observed_month"),
                         *[F.last(c, ignorenulls=True).over(w).alias(c) for c in value_cols])
    return filled.where(F.col("_spine") == 1).drop("_spine")


def expanding_features(df: DataFrame, points: Sequence[int] = range(6, 13), key: str = KEY,
                       order: str = ORDER, eps: float = 1e-5) -> DataFrame:
    """Snapshot features at every point t over all months <= t (declines vs the first month,
    summed delay counter, utilisation growth, cash-flow volatility, mean EMI-to-revenue)."""
    lo, hi = min(points), max(points)
    rows = (df.where(F.col(order) <= hi)  # a step, so that the sequence never runs downwards
            .withColumn("t", F.explode(F.sequence(F.greatest(F.col(order), F.lit(lo)), F.lit(hi), F.lit(1)))))
    snap = F.struct("gst_turnover", "monthly_sales", "account_balance", "credit_utilization", "sector",
                    "outstanding_loan" if "outstanding_loan" in df.columns else F.lit(None).alias("outstanding_loan"),
                    "default")
    g = rows.groupBy(key, "t").agg(
        F.min_by(snap, F.col(order)).alias("m1"),
        F.max_by(snap, F.col(order)).alias("cur"),
        F.sum("emi_delay_count").cast("long").alias("total_emi_delays"),
        F.stddev_samp(F.col("monthly_inflow") - F.col("monthly_outflow")).alias("_vol"),
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.col("monthly_outflow") * 0.2 / (F.col("monthly_sales") + eps)).alias("avg_emi_to_revenue"),
    )
    decline = lambda c: (F.col(f"m1.{c}") - F.col(f"cur.{c}")) / (F.col(f"m1.{c}") + eps)
    return g.select(
        key, F.col("t").alias(order), F.col("cur.sector").alias("sector"),
        decline("gst_turnover").alias("gst_decline_pct"),
        decline("monthly_sales").alias("revenue_decline_pct"),
        decline("account_balance").alias("balance_decline_pct"),
        "total_emi_delays",
        (F.col("cur.credit_utilization") - F.col("m1.credit_utilization")).alias("utilization_growth"),
        F.when(F.col("_n") > 1, F.col("_vol")).otherwise(F.lit(0.0)).alias("cashflow_volatility"),
        "avg_emi_to_revenue",
        F.col("cur.default").alias("default"),
    )


def running_sum(df: DataFrame, col: Column | str, name: str, key: str = KEY, order: str = ORDER) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(col) if isinstance(col, str) else col
    return df.withColumn(name, F.sum(c).over(w))


def floored_balance(df: DataFrame, opening: str, inflow: str, outflow: str, name: str = "floored_balance",
                    key: str = KEY, order: str = ORDER) -> DataFrame:
    """b_t = max(0, b_{t-1} + in_t - out_t), b_0 = opening >= 0, in closed form:
    S_t = opening + running sum of (in - out);  b_t = S_t - min(0, running min of S).
    Sums run in exact decimals so the result does not depend on evaluation order."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    delta = F.col(inflow).cast("decimal(30,6)") - F.col(outflow).cast("decimal(30,6)")
    s = F.col(opening).cast("decimal(30,6)") + F.sum(delta).over(w)
    tmp = df.withColumn("_s", s)
    return tmp.withColumn(name, (F.col("_s") - F.least(F.lit(0).cast("decimal(30,6)"),
                                                       F.min("_s").over(w))).cast("double")).drop("_s")


def derive_features(snap: DataFrame) -> DataFrame:
    """Monthly-blueprint columns -> the sixteen scorecard features.

    An upload that has all sixteen keeps them as they are. Otherwise they are derived; stress ratio,
    revenue trend, credit lines, real-estate loans and dependents are kept where present."""
    if set(K.MSME_FEATURES) <= set(snap.columns):
        return snap
    util = F.coalesce(F.col("credit_utilization"), F.lit(0.4)) if "credit_utilization" in snap.columns else F.lit(0.4)
    wc = F.coalesce(F.col("working_capital_usage"), F.lit(0.5)) if "working_capital_usage" in snap.columns else F.lit(0.5)
    emi = F.coalesce(F.col("emi_delay_count"), F.lit(0)) if "emi_delay_count" in snap.columns else F.lit(0)
    if {"monthly_inflow", "monthly_outflow"} <= set(snap.columns):
        ratio = F.try_divide(F.col("monthly_outflow"), F.nullif(F.col("monthly_inflow"), F.lit(0.0)))
        debt = clip(F.coalesce(ratio, F.lit(0.5)), 0.01, 3.0)
    else:
        debt = clip(util * 1.2, 0.01, 3.0)
    if "account_balance" in snap.columns:
        stab = clip(F.coalesce(F.col("account_balance"), F.lit(0.0)) / 500000.0, 0.0, 1.0)
    else:
        stab = F.lit(0.5)
    stress = F.col("cashflow_stress_ratio") if "cashflow_stress_ratio" in snap.columns else clip(debt, 0.0, 5.0)
    trend = F.col("revenue_trend_index") if "revenue_trend_index" in snap.columns else clip(1.2 - debt * 0.4, 0.2, 2.0)
    kept = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in snap.columns else F.lit(v)
    base = [c for c in snap.columns if c not in K.MSME_FEATURES]
    return snap.select(
        *base,
        clip(util, 0.01, 0.99).alias("revolving_utilization"),
        debt.alias("debt_ratio"),
        clip(emi, 0, 12).cast("int").alias("late_30_59"),
        clip(emi - 1, 0, 12).cast("int").alias("late_60_89"),
        clip(emi - 2, 0, 12).cast("int").alias("late_90_days"),
        kept("open_credit_lines", 8).cast("int").alias("open_credit_lines"),
        kept("real_estate_loans", 1).cast("int").alias("real_estate_loans"),
        kept("num_dependents", 1).cast("int").alias("num_dependents"),
        stab.alias("income_stability"),
        clip(1 - emi * 0.12, 0.0, 1.0).alias("gst_compliance_score"),
        stress.alias("cashflow_stress_ratio"),
        clip(wc, 0.0, 1.0).alias("working_capital_usage"),
        clip(emi, 0, 12).cast("int").alias("emi_delay_count"),
        trend.alias("revenue_trend_index"),
        clip(1 - emi * 0.08, 0.0, 1.0).alias("payment_history_score"),
        (emi > 2).cast("double").alias("supplier_payment_risk"),
    )


MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def derive_events(panel: DataFrame, year: Column, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Typed journey events from monthly state: missed or paid instalment, GST filing status,
    supplier-delay alert when working-capital usage is above 0.85. One row per event."""
    mon = F.element_at(F.array(*[F.lit(m) for m in MONTH_ABBR]), F.col(order))
    suffix = F.concat(F.lit(" — "), mon, F.lit(" "), year.cast("string"))
    missed = F.col("returns_in_month") > 0
    ev = F.array(
        F.when(missed, F.struct(F.lit(1).alias("seq"), F.lit("critical").alias("type"),
                                F.concat(F.lit("EMI Missed"), suffix).alias("desc")))
        .otherwise(F.struct(F.lit(1).alias("seq"), F.lit("success").alias("type"),
                            F.concat(F.lit("EMI Paid ✓"), suffix).alias("desc"))),
        F.when(missed, F.struct(F.lit(2).alias("seq"), F.lit("warning").alias("type"),
                                F.concat(F.lit("GST Filed Late"), suffix).alias("desc")))
        .otherwise(F.struct(F.lit(2).alias("seq"), F.lit("success").alias("type"),
                            F.concat(F.lit("GST Filed ✓"), suffix).alias("desc"))),
        F.when(F.col("working_capital_usage") > 0.85,
               F.struct(F.lit(3).alias("seq"), F.lit("critical").alias("type"),
                        F.lit("Supplier Payment Delay Detected").alias("desc"))),
    )
    kept = F.filter(ev, lambda e: e.isNotNull())
    return (panel.select(key, order, F.make_date(year.cast("int"), F.col(order), F.lit(12)).alias("date"),
                         F.explode(kept).alias("e"))
            .select(key, order, "date", "e.seq", "e.type", "e.desc"))
