"""Registered portfolio queries over the scored borrower view (DataFrame side + oracle SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import portfolio as P
from ..sources import views as V
from . import sql_views as S
from .registry import register

MONEY = 2  # decimal places kept for money sums


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored portfolio: PD, band, risk score, LGD, expected loss and recovery."""
    return P.with_expected_loss(P.with_lgd(P.with_risk(V.borrowers(spark, sf))))


V_SCORED = S.V_BORROWER + f""",
v_scored AS (
  SELECT *, {S.band('pd')} AS band, CAST(round_even(pd * 100, 0) AS INTEGER) AS risk_score,
         {S.lgd_fixture('sector')} AS lgd,
         pd * outstanding_loan * {S.lgd_fixture('sector')} AS expected_loss,
         outstanding_loan - pd * outstanding_loan * {S.lgd_fixture('sector')} AS potential_recovery
  FROM v_borrower)"""


def sql(body: str) -> str:
    return S.with_views(V_SCORED, body=body)


@register("sector_analytics", sql("""
SELECT sector, round(sum(outstanding_loan), 2) AS exposure, round(avg(pd), 6) AS avg_pd,
       round(sum(expected_loss), 2) AS expected_loss, count(*) AS borrower_count
FROM v_scored WHERE sector IS NOT NULL GROUP BY sector ORDER BY expected_loss DESC"""))
def q_sector_analytics(spark, sf):
    return P.round_doubles(P.sector_analytics(scored(spark, sf)), 6, {"exposure": MONEY, "expected_loss": MONEY})


@register("portfolio_totals", sql("""
SELECT count(*) AS total_borrowers, round(avg(pd), 6) AS avg_pd, round(sum(outstanding_loan), 2) AS total_exposure,
       round(sum(expected_loss), 2) AS total_expected_loss FROM v_scored"""))
def q_portfolio_totals(spark, sf):
    return P.round_doubles(P.portfolio_totals(scored(spark, sf)), 6,
                           {"total_exposure": MONEY, "total_expected_loss": MONEY})


@register("band_distribution", sql("""
SELECT b.band, b.band_order, coalesce(c.n, 0) AS borrowers
FROM (VALUES ('Low', 0), ('Medium', 1), ('High', 2), ('Critical', 3)) AS b(band, band_order)
LEFT JOIN (SELECT band, count(*) AS n FROM v_scored WHERE band IS NOT NULL GROUP BY band) c ON b.band = c.band"""))
def q_band_distribution(spark, sf):
    return P.band_distribution(scored(spark, sf))


@register("risk_band", sql("""
SELECT company_id, round(pd, 6) AS pd, band FROM v_scored"""))
def q_risk_band(spark, sf):
    return P.round_doubles(scored(spark, sf).select("company_id", "pd", "band"))


@register("risk_score", sql("""
SELECT company_id, risk_score FROM v_scored"""))
def q_risk_score(spark, sf):
    return scored(spark, sf).select("company_id", "risk_score")


@register("lgd_lookup", sql(f"""
SELECT company_id, sector, {S.lgd_fixture('sector')} AS lgd FROM v_borrower"""))
def q_lgd_lookup(spark, sf):
    dim = P.dim_from_mapping(spark, K.LGD_FIXTURE, "sector", "lgd")
    return P.lookup(V.borrowers(spark, sf).select("company_id", "sector"), dim, "sector", "lgd",
                    K.LGD_FIXTURE_DEFAULT)


@register("expected_loss", sql("""
SELECT company_id, round(expected_loss, 4) AS expected_loss, round(potential_recovery, 4) AS potential_recovery,
       lgd, round(pd, 6) AS pd, round(outstanding_loan, 2) AS outstanding_loan FROM v_scored"""))
def q_expected_loss(spark, sf):
    df = scored(spark, sf).select("company_id", "expected_loss", "potential_recovery", "lgd", "pd", "outstanding_loan")
    return P.round_doubles(df, 6, {"expected_loss": 4, "potential_recovery": 4, "outstanding_loan": MONEY})


@register("top_borrowers", sql("""
SELECT company_id, sector, loan_type, round(pd, 6) AS pd, round(outstanding_loan, 2) AS outstanding_loan,
       band AS risk_band, risk_score
FROM v_scored ORDER BY margin DESC NULLS LAST, company_id ASC LIMIT 50"""))
def q_top_borrowers(spark, sf):
    return P.round_doubles(P.top_borrowers(scored(spark, sf), 50), 6, {"outstanding_loan": MONEY})


@register("attention_list", sql("""
SELECT company_id, sector, round(pd, 6) AS pd, band FROM v_scored ORDER BY margin DESC NULLS LAST, company_id ASC LIMIT 5"""))
def q_attention_list(spark, sf):
    return P.top_borrowers(scored(spark, sf), 5, ("company_id", "sector", "pd", "band"), extra=False)


@register("upload_summary", sql("""
SELECT (SELECT count(*) FROM customer) AS rows_ingested, count(*) AS borrowers_scored,
       round(avg(pd), 6) AS avg_pd, count(*) FILTER (WHERE pd >= 0.5) AS high_risk_count FROM v_scored"""))
def q_upload_summary(spark, sf):
    from ..sources.tables import read_table
    rows = read_table(spark, sf, "customer", ["c_custkey"])
    return P.round_doubles(P.upload_summary(rows, scored(spark, sf)))


@register("refresh_summary", sql("""
SELECT count(*) FILTER (WHERE sector = 'HOUSEHOLD') AS added, count(*) AS total_borrowers,
       count(*) FILTER (WHERE sector = 'HOUSEHOLD' AND pd >= 0.5) AS new_high_risk,
       round(avg(pd) FILTER (WHERE sector = 'HOUSEHOLD'), 6) AS new_avg_pd FROM v_scored"""))
def q_refresh_summary(spark, sf):
    """Refresh: the HOUSEHOLD segment arrives as a new batch on top of the rest of the portfolio."""
    s = scored(spark, sf)
    current = s.where(~F.col("sector").eqNullSafe("HOUSEHOLD"))
    batch = s.where(F.col("sector") == "HOUSEHOLD")
    return P.round_doubles(P.refresh_summary(current, batch))


@register("append_portfolio", sql("""
SELECT company_id, sector, round(pd, 6) AS pd, NULL::VARCHAR AS batch FROM v_scored WHERE sector IS DISTINCT FROM 'HOUSEHOLD'
UNION ALL
SELECT company_id, sector, round(pd, 6) AS pd, 'refresh' AS batch FROM v_scored WHERE sector = 'HOUSEHOLD'"""))
def q_append_portfolio(spark, sf):
    s = scored(spark, sf).select("company_id", "sector", "pd")
    current = s.where(~F.col("sector").eqNullSafe("HOUSEHOLD"))
    batch = s.where(F.col("sector") == "HOUSEHOLD").withColumn("batch", F.lit("refresh"))
    return P.round_doubles(P.append_portfolio(current, batch))


@register("class_balance", sql("""
SELECT count(*) AS n, CAST(sum("default") AS BIGINT) AS n_default, round(avg(CAST("default" AS DOUBLE)), 6) AS default_rate,
       count(*) FILTER (WHERE "default" = 0) AS n_healthy,
       round(avg(CASE WHEN "default" = 0 THEN 1.0 ELSE 0.0 END), 6) AS healthy_rate FROM v_borrower"""))
def q_class_balance(spark, sf):
    return P.round_doubles(P.class_balance(V.borrowers(spark, sf)))


@register("class_weight", sql("""
SELECT n_neg, n_pos, round(n_neg::DOUBLE / nullif(n_pos, 0), 6) AS scale_pos_weight,
       round((n_neg + n_pos)::DOUBLE / nullif(2 * n_neg, 0), 6) AS w_neg,
       round((n_neg + n_pos)::DOUBLE / nullif(2 * n_pos, 0), 6) AS w_pos
FROM (SELECT count(*) FILTER (WHERE "default" = 0) AS n_neg, count(*) FILTER (WHERE "default" = 1) AS n_pos FROM v_borrower)"""))
def q_class_weight(spark, sf):
    return P.round_doubles(P.class_weight(V.borrowers(spark, sf)))


def _ladder_values(ladder) -> str:
    rows = []
    for b, acts in ladder.items():
        for i, (p, a, d) in enumerate(acts):
            rows.append("('{}', {}, '{}', '{}', '{}')".format(b, i + 1, p, a.replace("'", "''"), d.replace("'", "''")))
    return ", ".join(rows)


@register("action_plan", sql(f"""
SELECT s.company_id, s.band, l.seq, l.priority, l.action, l.detail
FROM v_scored s JOIN (VALUES {_ladder_values(K.ACTION_LADDER_MSME)}) AS l(band, seq, priority, action, detail)
  ON s.band = l.band"""))
def q_action_plan(spark, sf):
    return P.action_plan(scored(spark, sf).select("company_id", "band")).select(
        "company_id", "band", "seq", "priority", "action", "detail")


@register("assign_ids", sql("""
SELECT company_id, printf('UP-%04d', row_number() OVER (ORDER BY company_id)) AS upload_id FROM v_borrower"""))
def q_assign_ids(spark, sf):
    return P.assign_ids(V.borrowers(spark, sf).select("company_id"), "company_id")
