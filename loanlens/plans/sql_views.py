"""Fixture views as ANSI SQL (DuckDB dialect) for the oracle side of the correctness gate.

Written independently of the DataFrame code in ``loanlens.sources.views``: the two must agree.
"""

from __future__ import annotations

from ..functions import constants as K


def clip(x: str, lo=None, hi=None) -> str:
    out = x
    if lo is not None:
        out = f"greatest({out}, {lo})"
    if hi is not None:
        out = f"least({out}, {hi})"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE {out} END)"


def band(p: str) -> str:
    return (f"(CASE WHEN ({p}) IS NULL THEN NULL WHEN ({p}) < 0.20 THEN 'Low' WHEN ({p}) < 0.50 THEN 'Medium' "
            f"WHEN ({p}) < 0.75 THEN 'High' ELSE 'Critical' END)")


def sigmoid(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def lgd_fixture(sector: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.LGD_FIXTURE.items())
    return f"CAST(CASE {sector} {whens} ELSE {K.LGD_FIXTURE_DEFAULT} END AS DOUBLE)"


BORROWER_FEATURES = f"""
bf_orders AS (
  SELECT o_custkey,
         sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0.0 END) AS ead,
         sum(o_totalprice) AS total_price,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS n_partial
  FROM orders GROUP BY o_custkey),
bf_latest AS (
  SELECT o_custkey, o_orderpriority AS loan_type FROM (
    SELECT o_custkey, o_orderpriority,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn = 1),
bf_lines AS (
  SELECT o.o_custkey,
         avg(l.l_discount) AS avg_discount,
         count(*) FILTER (WHERE date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) BETWEEN 30 AND 59) AS n_30,
         count(*) FILTER (WHERE date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) BETWEEN 60 AND 89) AS n_60,
         count(*) FILTER (WHERE date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) BETWEEN 90 AND 119) AS n_90,
         avg(CASE WHEN l.l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS return_share
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey),
bf_cust AS (
  SELECT c.c_custkey AS company_id, c.c_mktsegment AS sector, r.r_name AS home,
         CAST(c.c_nationkey % 5 AS INTEGER) AS num_dependents,
         CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal END AS monthly_income
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
                  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
bf_med AS (SELECT median(monthly_income) AS med_income FROM bf_cust),
bf_base AS (
  SELECT c.company_id, c.sector, lt.loan_type,
         TRY_CAST(substr(lt.loan_type, 1, 1) AS INTEGER) AS grade,
         c.home,
         coalesce(o.ead, 0.0) AS outstanding_loan,
         c.monthly_income,
         {clip('li.avg_discount * 10', 0.01, 0.99)} AS revolving_utilization,
         {clip('coalesce(o.ead, 0.0) / nullif(o.total_price, 0.0)', 0.01, 3.0)} AS debt_ratio,
         CAST(coalesce(li.n_30, 0) AS INTEGER) AS late_30_59,
         CAST(coalesce(li.n_60, 0) AS INTEGER) AS late_60_89,
         CAST(coalesce(li.n_90, 0) AS INTEGER) AS late_90_days,
         CAST(coalesce(o.n_open, 0) AS INTEGER) AS open_credit_lines,
         CAST(least(coalesce(o.n_partial, 0), 4) AS INTEGER) AS real_estate_loans,
         c.num_dependents,
         {clip('coalesce(c.monthly_income, m.med_income) / CAST(100000.0 AS DOUBLE)', 0.0, 1.0)} AS income_stability,
         CAST(coalesce(li.return_share, 0.0) > 1.0 / 3.0 AS INTEGER) AS "default"
  FROM bf_cust c
  LEFT JOIN bf_orders o ON c.company_id = o.o_custkey
  LEFT JOIN bf_latest lt ON c.company_id = lt.o_custkey
  LEFT JOIN bf_lines li ON c.company_id = li.o_custkey
  CROSS JOIN bf_med m),
v_borrower_features AS (
  SELECT *,
         {clip('1 - CAST(late_30_59 AS DOUBLE) * 0.12', 0.0, 1.0)} AS gst_compliance_score,
         CAST({clip('late_30_59 + late_60_89', 0, 12)} AS INTEGER) AS emi_delay_count,
         {clip('debt_ratio', 0.0, 5.0)} AS cashflow_stress_ratio,
         {clip('revolving_utilization * 0.6 + 0.1', 0.0, 1.0)} AS working_capital_usage,
         {clip('1.2 - debt_ratio * 0.4', 0.2, 2.0)} AS revenue_trend_index,
         {clip('1 - CAST(late_90_days AS DOUBLE) * 0.2 - CAST(late_30_59 AS DOUBLE) * 0.05', 0.0, 1.0)} AS payment_history_score,
         CAST(late_30_59 > 2 AS DOUBLE) + CAST(late_90_days > 0 AS DOUBLE) AS supplier_payment_risk
  FROM bf_base)"""


def _zstats() -> str:
    parts = []
    for f in K.MSME_FEATURES:
        parts.append(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}")
    return ",\n         ".join(parts)


def _margin(intercept: float) -> str:
    terms = [f"({w}) * ((b.{f} - z.m_{f}) / (z.s_{f} + {K.ZSCORE_EPS}))" for f, w in K.SCORECARD_WEIGHTS.items()]
    return " + ".join(terms) + f" + ({intercept})"


V_BORROWER = BORROWER_FEATURES + f""",
bz AS (SELECT {_zstats()} FROM v_borrower_features),
v_borrower AS (
  SELECT b.*, {_margin(K.FIXTURE_INTERCEPT)} AS margin, {sigmoid(_margin(K.FIXTURE_INTERCEPT))} AS pd
  FROM v_borrower_features b CROSS JOIN bz z)"""


def with_views(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + body


V_APPLICATIONS = """
v_applications AS (
  SELECT o.o_orderkey AS loan_id, o.o_custkey AS company_id,
         CAST(18 + floor(c.c_acctbal / 100) AS INTEGER) AS person_age,
         CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal * 12 END AS person_income,
         CASE WHEN o.o_orderstatus <> 'P' THEN o.o_totalprice / 5000.0 END AS person_emp_length,
         r.r_name AS person_home_ownership,
         c.c_mktsegment AS loan_intent,
         chr(64 + TRY_CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER)) AS loan_grade,
         o.o_totalprice AS loan_amnt,
         CAST(5.0 AS DOUBLE) + CAST(2.5 AS DOUBLE) * TRY_CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS loan_int_rate,
         o.o_totalprice / nullif(CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal * 12 END, 0.0) AS loan_percent_income,
         CASE o.o_orderstatus WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' END AS cb_person_default_on_file,
         CAST(year(o.o_orderdate) - 1990 AS INTEGER) AS cb_person_cred_hist_length,
         CAST(o.o_orderstatus = 'F' AND o.o_totalprice > 200000 AS INTEGER) AS loan_status
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
                LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
                LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""

V_LOANS = """
v_loans AS (
  SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, l.l_returnflag || l.l_linestatus AS loan_status,
         o.o_orderpriority AS grade, l.l_tax * 100 AS interest_rate, l.l_discount * 100 AS debt_to_income,
         CAST(l.l_linenumber - 1 AS INTEGER) AS delinq_2y,
         l.l_extendedprice * (1 - l.l_discount) AS total_credit_utilized, l.l_extendedprice AS total_credit_limit,
         CAST(l.l_returnflag = 'R' AS INTEGER) AS num_accounts_30d_past_due,
         CAST(l.l_linestatus = 'O' AS INTEGER) AS num_historical_failed_to_pay,
         CAST(l.l_quantity AS INTEGER) AS open_credit_lines, CAST(NULL AS INTEGER) AS num_mort_accounts,
         o.o_totalprice AS annual_income, 100.0 - l.l_tax * 1000 AS account_never_delinq_percent
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def title_case(x: str) -> str:
    """Upper case after every character that is no letter, lower case elsewhere."""
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|\\P{{L}}+'), "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')")


V_PANEL = """
pm AS (
  SELECT l.l_suppkey, CAST(l.l_suppkey * 10000 + year(l.l_shipdate) AS BIGINT) AS company_id, CAST(month(l.l_shipdate) AS INTEGER) AS month,
         sum(CAST(l.l_extendedprice AS DECIMAL(15,2))) AS s_sales,
         sum(CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l.l_discount AS DECIMAL(15,2)))) AS s_inflow,
         sum(CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l.l_discount AS DECIMAL(15,2)))
             * (1 + CAST(l.l_tax AS DECIMAL(15,2)))) AS s_gst,
         sum(CAST(l.l_quantity AS DECIMAL(15,2)) * CAST(p.p_retailprice AS DECIMAL(15,2))) AS s_outflow,
         sum(CAST(l.l_discount AS DECIMAL(15,2))) AS s_disc, sum(CAST(l.l_tax AS DECIMAL(15,2))) AS s_tax,
         count(*) AS n_lines,
         CAST(count(*) FILTER (WHERE l.l_returnflag = 'R') AS INTEGER) AS returns_in_month
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
  WHERE l.l_shipdate IS NOT NULL
  GROUP BY 1, 2, 3),
v_panel AS (
  SELECT pm.company_id, pm.month, r.r_name AS sector,
         CAST(s_sales AS DOUBLE) AS monthly_sales, CAST(s_gst AS DOUBLE) AS gst_turnover,
         CAST(s_inflow AS DOUBLE) AS monthly_inflow, CAST(s_outflow AS DOUBLE) AS monthly_outflow,
         CAST(s_disc AS DOUBLE) / n_lines * 10 AS credit_utilization,
         CAST(s_tax AS DOUBLE) / n_lines * 10 AS working_capital_usage,
         returns_in_month,
         CAST(sum(returns_in_month) OVER (PARTITION BY pm.company_id ORDER BY pm.month
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS emi_delay_count,
         CAST(CAST(s.s_acctbal AS DECIMAL(15,2)) + sum(s_inflow - s_outflow) OVER (PARTITION BY pm.company_id ORDER BY pm.month
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS account_balance,
         coalesce(greatest(s.s_acctbal, 0.0), 0.0) AS opening_balance,
         CAST(sum(returns_in_month) OVER (PARTITION BY pm.company_id) * 3 > sum(n_lines) OVER (PARTITION BY pm.company_id) AS INTEGER) AS "default"
  FROM pm LEFT JOIN supplier s ON pm.l_suppkey = s.s_suppkey
          LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
          LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def _legacy_margin() -> str:
    feats = ["revolving_utilization", "debt_ratio", "late_90_days"]
    terms = [f"({K.SCORECARD_WEIGHTS[f]}) * ((b.{f} - z.m_{f}) / (z.s_{f} + {K.ZSCORE_EPS}))" for f in feats]
    return " + ".join(terms) + f" + ({K.FIXTURE_INTERCEPT})"


V_SCORES = V_BORROWER + f""",
v_scores AS (
  SELECT 'scorecard' AS model, company_id AS id, "default" AS y_true, round(pd, 12) AS prob FROM v_borrower
  UNION ALL
  SELECT 'legacy3', b.company_id, b."default", round({sigmoid(_legacy_margin())}, 12) FROM v_borrower b CROSS JOIN bz z
  UNION ALL
  SELECT 'proxy', company_id, "default",
         round({clip('0.35 * revolving_utilization + 0.30 * least(emi_delay_count / 4.0, 1.0) + 0.25 * least(CAST(late_90_days AS DOUBLE), 2.0) / 2.0 + 0.10 * (1 - payment_history_score)', 0.0, 1.0)}, 12)
  FROM v_borrower)"""
