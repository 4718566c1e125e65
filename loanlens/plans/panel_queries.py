"""Registered queries over the monthly company panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import panel as PN
from ..operators.asof import asof_join
from ..operators.portfolio import round_doubles, with_risk
from ..operators.scorecard import fit_zscore, score
from ..sources import tables as TB
from ..sources import views as V
from . import sql_views as S
from .registry import register


def psql(body: str, *extra: str) -> str:
    return S.with_views(S.V_PANEL, *extra, body=body)


@register("latest_snapshot", psql("""
SELECT company_id, month, sector, monthly_sales, monthly_inflow, monthly_outflow, emi_delay_count, account_balance
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS rn FROM v_panel) WHERE rn = 1"""))
def q_latest_snapshot(spark, sf):
    p = V.panel(spark, sf).select("company_id", "month", "sector", "monthly_sales", "monthly_inflow",
                                  "monthly_outflow", "emi_delay_count", "account_balance")
    return PN.latest_snapshot(p)


COLLAPSE = """
pc AS (
  SELECT company_id,
         arg_max(monthly_sales, month) AS last_sales, arg_min(monthly_sales, month) AS first_sales,
         arg_max(monthly_inflow, month) AS last_in, arg_max(monthly_outflow, month) AS last_out,
         stddev_samp(monthly_inflow - monthly_outflow) AS vol, count(*) AS months_observed
  FROM v_panel GROUP BY company_id)"""


@register("revenue_trend", psql(f"""
SELECT company_id, {S.clip('CASE WHEN first_sales IS NULL OR first_sales = 0 THEN 0.0 ELSE last_sales / first_sales END', 0.2, 2.0)} AS revenue_trend_index,
       months_observed FROM pc""", COLLAPSE))
def q_revenue_trend(spark, sf):
    return PN.monthly_collapse(V.panel(spark, sf)).select("company_id", "revenue_trend_index", "months_observed")


@register("cashflow_stress", psql(f"""
SELECT company_id, {S.clip('CASE WHEN last_in IS NULL OR last_in = 0 THEN 0.0 ELSE last_out / last_in END * 2.0', 0.0, 5.0)} AS cashflow_stress_ratio,
       round(CASE WHEN months_observed > 1 THEN vol ELSE 0.0 END, 4) AS cashflow_volatility FROM pc""", COLLAPSE))
def q_cashflow_stress(spark, sf):
    out = PN.monthly_collapse(V.panel(spark, sf)).select("company_id", "cashflow_stress_ratio", "cashflow_volatility")
    return out.withColumn("cashflow_volatility", F.round("cashflow_volatility", 4))


@register("asof_snapshot", psql("""
SELECT c.company_id, t.month,
       (SELECT max(p.month) FROM v_panel p WHERE p.company_id = c.company_id AND p.month <= t.month) AS observed_month,
       (SELECT arg_max(p.monthly_sales, p.month) FROM v_panel p WHERE p.company_id = c.company_id AND p.month <= t.month) AS monthly_sales,
       (SELECT arg_max(p.emi_delay_count, p.month) FROM v_panel p WHERE p.company_id = c.company_id AND p.month <= t.month) AS emi_delay_count
FROM (SELECT DISTINCT company_id FROM v_panel) c CROSS JOIN range(6, 13) AS t(month)"""))
def q_asof_snapshot(spark, sf):
    p = V.panel(spark, sf)
    out = PN.asof_snapshots(p, ["monthly_sales", "emi_delay_count"])
    return out.select("company_id", F.col("month").cast("long").alias("month"), "observed_month", "monthly_sales",
                      "emi_delay_count")


@register("expanding_features", psql("""
SELECT company_id, t AS month, arg_max(sector, month) AS sector,
       (arg_min(gst_turnover, month) - arg_max(gst_turnover, month)) / (arg_min(gst_turnover, month) + 1e-5) AS gst_decline_pct,
       (arg_min(monthly_sales, month) - arg_max(monthly_sales, month)) / (arg_min(monthly_sales, month) + 1e-5) AS revenue_decline_pct,
       (arg_min(account_balance, month) - arg_max(account_balance, month)) / (arg_min(account_balance, month) + 1e-5) AS balance_decline_pct,
       CAST(sum(emi_delay_count) AS BIGINT) AS total_emi_delays,
       arg_max(credit_utilization, month) - arg_min(credit_utilization, month) AS utilization_growth,
       round(CASE WHEN count(*) > 1 THEN stddev_samp(monthly_inflow - monthly_outflow) ELSE 0.0 END, 4) AS cashflow_volatility,
       round(avg(monthly_outflow * 0.2 / (monthly_sales + 1e-5)), 6) AS avg_emi_to_revenue,
       arg_max("default", month) AS "default"
FROM v_panel CROSS JOIN range(6, 13) AS r(t) WHERE month <= t GROUP BY company_id, t"""))
def q_expanding_features(spark, sf):
    out = PN.expanding_features(V.panel(spark, sf))
    return (out.withColumn("month", F.col("month").cast("long"))
            .withColumn("cashflow_volatility", F.round("cashflow_volatility", 4))
            .withColumn("avg_emi_to_revenue", F.round("avg_emi_to_revenue", 6)))


_NOTES = """
pn AS (SELECT doc_id AS note_id, CAST((doc_id % 100 + 1) * 10000 + 1992 + doc_id % 7 AS BIGINT) AS company_id, CAST((doc_id // 7) % 12 + 1 AS INT) AS month, text FROM documents),
pe AS (SELECT company_id, month, 1 AS seq, CASE WHEN returns_in_month > 0 THEN 'critical' ELSE 'success' END AS type FROM v_panel
       UNION ALL SELECT company_id, month, 2, CASE WHEN returns_in_month > 0 THEN 'warning' ELSE 'success' END FROM v_panel
       UNION ALL SELECT company_id, month, 3, 'critical' FROM v_panel WHERE working_capital_usage > 0.85)"""


@register("expanding_snapshots", psql("""
SELECT x.company_id, CAST(x.t AS INT) AS month, 1000000.0::DOUBLE AS outstanding_loan, n.month AS note_month, coalesce(n.text, '') AS officer_note,
       (SELECT string_agg(type, '>' ORDER BY month, seq) FROM pe WHERE pe.company_id = x.company_id AND pe.month <= x.t) AS journey
FROM (SELECT DISTINCT p.company_id, r.t FROM v_panel p JOIN range(6, 13) AS r(t) ON p.month <= r.t) x
LEFT JOIN LATERAL (SELECT month, text FROM pn WHERE pn.company_id = x.company_id AND pn.month <= x.t ORDER BY pn.month DESC, note_id DESC LIMIT 1) n ON true""", _NOTES))
def q_expanding_snapshots(spark, sf):
    """Exposure, last officer note and journey of every account at months 6 to 12: the note by an as-of join, the journey as
    all events to date (three a month and twelve months at most)."""
    panel = TB.add_defaults(V.panel(spark, sf), {"outstanding_loan": K.UPLOAD_DEFAULTS_MSME["outstanding_loan"]})
    points = (panel.where("month <= 12").select("company_id", F.col("month").alias("m"), "outstanding_loan")
              .withColumn("month", F.explode(F.sequence(F.greatest("m", F.lit(6)), F.lit(12), F.lit(1)))))
    points = points.groupBy("company_id", "month").agg(F.max_by("outstanding_loan", "m").alias("outstanding_loan"))
    noted = asof_join(points, V.panel_notes(spark, sf), "company_id", "month", ["text"], 3, tie="note_id", found="note_month")
    events = PN.derive_events(panel, F.col("company_id") % 10000)
    seen = events.withColumn("t", F.explode(F.sequence(F.greatest("month", F.lit(6)), F.lit(12), F.lit(1))))
    journey = seen.groupBy("company_id", F.col("t").alias("month")).agg(F.array_sort(F.collect_list(F.struct(F.col("month").alias("at"), "seq", "type"))).alias("j"))
    return noted.join(journey, ["company_id", "month"], "left").select(
        "company_id", "month", "outstanding_loan", "note_month", F.coalesce("text", F.lit("")).alias("officer_note"),
        F.array_join(F.transform("j", lambda e: e["type"]), ">").alias("journey"))


@register("running_delays", psql("""
SELECT company_id, month, CAST(monthly_outflow > monthly_inflow AS INTEGER) AS missed,
       CAST(sum(CAST(monthly_outflow > monthly_inflow AS INTEGER)) OVER (PARTITION BY company_id ORDER BY month
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS missed_to_date
FROM v_panel"""))
def q_running_delays(spark, sf):
    p = V.panel(spark, sf).select("company_id", "month",
                                  (F.col("monthly_outflow") > F.col("monthly_inflow")).cast("int").alias("missed"))
    return PN.running_sum(p, "missed", "missed_to_date")


@register("floored_balance", psql("""
SELECT company_id, month,
       CAST(s - least(0, min(s) OVER (PARTITION BY company_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS DOUBLE) AS floored_balance
FROM (SELECT company_id, month,
             CAST(opening_balance AS DECIMAL(30,6)) + sum(CAST(monthly_inflow AS DECIMAL(30,6)) - CAST(monthly_outflow AS DECIMAL(30,6)))
               OVER (PARTITION BY company_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
      FROM v_panel)"""))
def q_floored_balance(spark, sf):
    p = V.panel(spark, sf).select("company_id", "month", "opening_balance", "monthly_inflow", "monthly_outflow")
    return PN.floored_balance(p, "opening_balance", "monthly_inflow", "monthly_outflow").select(
        "company_id", "month", "floored_balance")


DERIVED = COLLAPSE + """,
pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS rn FROM v_panel) WHERE rn = 1),
pd_in AS (
  SELECT pl.company_id, pl.sector, coalesce(pl.credit_utilization, 0.4) AS util, coalesce(pl.working_capital_usage, 0.5) AS wc,
         coalesce(pl.emi_delay_count, 0) AS emi, pl.account_balance,
         """ + S.clip("coalesce(pl.monthly_outflow / nullif(pl.monthly_inflow, 0.0), 0.5)", 0.01, 3.0) + """ AS debt,
         """ + S.clip("CASE WHEN pc.first_sales IS NULL OR pc.first_sales = 0 THEN 0.0 ELSE pc.last_sales / pc.first_sales END", 0.2, 2.0) + """ AS trend,
         """ + S.clip("CASE WHEN pc.last_in IS NULL OR pc.last_in = 0 THEN 0.0 ELSE pc.last_out / pc.last_in END * 2.0", 0.0, 5.0) + """ AS stress
  FROM pl JOIN pc ON pl.company_id = pc.company_id),
v_derived AS (
  SELECT company_id, sector,
         """ + S.clip("util", 0.01, 0.99) + """ AS revolving_utilization, debt AS debt_ratio,
         CAST(""" + S.clip("emi", 0, 12) + """ AS INTEGER) AS late_30_59,
         CAST(""" + S.clip("emi - 1", 0, 12) + """ AS INTEGER) AS late_60_89,
         CAST(""" + S.clip("emi - 2", 0, 12) + """ AS INTEGER) AS late_90_days,
         8 AS open_credit_lines, 1 AS real_estate_loans, 1 AS num_dependents,
         """ + S.clip("coalesce(account_balance, 0.0) / 500000.0", 0.0, 1.0) + """ AS income_stability,
         """ + S.clip("1 - CAST(emi AS DOUBLE) * 0.12", 0.0, 1.0) + """ AS gst_compliance_score,
         CAST(""" + S.clip("emi", 0, 12) + """ AS INTEGER) AS emi_delay_count,
         stress AS cashflow_stress_ratio,
         """ + S.clip("wc", 0.0, 1.0) + """ AS working_capital_usage,
         trend AS revenue_trend_index,
         """ + S.clip("1 - CAST(emi AS DOUBLE) * 0.08", 0.0, 1.0) + """ AS payment_history_score,
         CAST(emi > 2 AS DOUBLE) AS supplier_payment_risk
  FROM pd_in)"""


def derived_panel(spark, sf):
    return PN.derive_features(PN.monthly_collapse(V.panel(spark, sf)))


@register("derive_features", psql("SELECT company_id, " + ", ".join(K.MSME_FEATURES) + " FROM v_derived", DERIVED))
def q_derive_features(spark, sf):
    return derived_panel(spark, sf).select("company_id", *K.MSME_FEATURES)


def _z_terms() -> str:
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in K.MSME_FEATURES)
    margin = " + ".join(f"({w}) * ((d.{f} - z.m_{f}) / (z.s_{f} + {K.ZSCORE_EPS}))" for f, w in K.SCORECARD_WEIGHTS.items())
    return stats, margin + f" + ({K.FIXTURE_INTERCEPT})"


_ZS, _MARGIN = _z_terms()


@register("ingest_portfolio", psql(f"""
SELECT company_id, sector, round(pd, 6) AS pd, {S.band('pd')} AS band FROM (
  SELECT d.company_id, d.sector, {S.sigmoid(_MARGIN)} AS pd
  FROM v_derived d CROSS JOIN (SELECT {_ZS} FROM v_derived) z)""", DERIVED))
def q_ingest_portfolio(spark, sf):
    """Upload path: monthly rows -> one snapshot per company -> 16 features -> score."""
    feat = derived_panel(spark, sf)
    scored = with_risk(score(feat, fit_zscore(feat, K.MSME_FEATURES)))
    return round_doubles(scored.select("company_id", "sector", "pd", "band"))


@register("derive_events", psql("""
SELECT company_id, month, make_date(CAST(company_id % 10000 AS INTEGER), month, 12) AS date, e.seq, e.type, e."desc" FROM (
  SELECT company_id, month, unnest([
    CASE WHEN returns_in_month > 0 THEN {'seq': 1, 'type': 'critical', 'desc': 'EMI Missed — ' || m || ' ' || (company_id % 10000)}
         ELSE {'seq': 1, 'type': 'success', 'desc': 'EMI Paid ✓ — ' || m || ' ' || (company_id % 10000)} END,
    CASE WHEN returns_in_month > 0 THEN {'seq': 2, 'type': 'warning', 'desc': 'GST Filed Late — ' || m || ' ' || (company_id % 10000)}
         ELSE {'seq': 2, 'type': 'success', 'desc': 'GST Filed ✓ — ' || m || ' ' || (company_id % 10000)} END,
    CASE WHEN working_capital_usage > 0.85 THEN {'seq': 3, 'type': 'critical', 'desc': 'Supplier Payment Delay Detected'} END
  ]) AS e
  FROM (SELECT *, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month] AS m FROM v_panel))
WHERE e IS NOT NULL"""))
def q_derive_events(spark, sf):
    return PN.derive_events(V.panel(spark, sf), F.col("company_id") % 10000)


@register("label_align", psql("""
SELECT company_id, arg_min("default", month) AS "default", count(*) AS months FROM v_panel
WHERE "default" IS NOT NULL GROUP BY company_id"""))
def q_label_align(spark, sf):
    p = V.panel(spark, sf)
    labels = (p.where(F.col("default").isNotNull()).groupBy("company_id")
              .agg(F.min_by("default", "month").alias("default")))
    feats = p.groupBy("company_id").agg(F.count(F.lit(1)).alias("months"))
    missing = feats.join(labels, "company_id", "left_anti")
    if missing.limit(1).count():
        raise ValueError("companies without a label")
    return feats.join(labels, "company_id", "inner").select("company_id", "default", "months")


@register("panel_stats", psql("""
SELECT count(*) AS n_rows, count(DISTINCT company_id) AS n_companies, count(DISTINCT month) AS n_months,
       count(DISTINCT sector) AS n_sectors FROM v_panel"""))
def q_panel_stats(spark, sf):
    p = V.panel(spark, sf)
    return p.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("company_id").alias("n_companies"),
                 F.count_distinct("month").alias("n_months"), F.count_distinct("sector").alias("n_sectors"))


UPLOAD_CONTRACT_COLUMNS = [
    ("company_id", "bigint"), ("month", "int"), ("sector", "string"), ("monthly_sales", "double"),
    ("gst_turnover", "double"), ("monthly_inflow", "double"), ("monthly_outflow", "double"),
    ("credit_utilization", "double"), ("working_capital_usage", "double"), ("emi_delay_count", "int"),
    ("account_balance", "double"),
]


@register("upload_csv", psql(f"""
SELECT (SELECT count(*) FROM v_panel) AS rows_ingested, count(*) AS borrowers_scored, round(avg(pd), 6) AS avg_pd,
       count(*) FILTER (WHERE pd >= 0.5) AS high_risk_count
FROM (SELECT {S.sigmoid(_MARGIN)} AS pd FROM v_derived d CROSS JOIN (SELECT {_ZS} FROM v_derived) z)""", DERIVED))
def q_upload_csv(spark, sf):
    """Monthly blueprint upload as CSV (header names padded with spaces, every column text):
    trim headers, enforce the contract with try_cast, collapse to one snapshot per company,
    derive features, score, and summarise input rows versus scored borrowers."""
    from pyspark.sql import types as T

    from ..operators.portfolio import upload_summary
    from ..sources import tables as TB
    from ..streaming.stream import scratch
    path = scratch(spark, "upload_csv")
    cols = [c for c, _ in UPLOAD_CONTRACT_COLUMNS]
    p = V.panel(spark, sf).select(*cols)
    p.toDF(*[f" {c} " for c in cols]).write.option("header", True).csv(path)
    raw = spark.read.option("header", True).csv(path)  # all columns as text, no inference pass
    contract = T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in UPLOAD_CONTRACT_COLUMNS))
    upload = TB.conform(raw, contract, required=["company_id", "month"])
    feat = PN.derive_features(PN.monthly_collapse(upload))
    scored = score(feat, fit_zscore(feat, K.MSME_FEATURES))
    return round_doubles(upload_summary(upload, scored))
