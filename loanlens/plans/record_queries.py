"""Registered record-level queries: conform, clean, encode, scalar features, loan statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import scalars as X
from ..operators import clean as C
from ..operators import features as FE
from ..operators.ordered import column_quantiles
from ..operators.portfolio import round_doubles
from ..sources import tables as TB
from ..sources import views as V
from . import sql_views as S
from .registry import register

# Fixture status list for the loan view: returned lines count as defaults there.
FIXTURE_DEFAULT_STATUSES = ["ro", "rf"]

CREDIT_CONTRACT = T.StructType([
    T.StructField("loan_id", T.LongType()),
    T.StructField("person_age", T.IntegerType()),
    T.StructField("person_income", T.DoubleType()),
    T.StructField("person_emp_length", T.DoubleType()),
    T.StructField("person_home_ownership", T.StringType()),
    T.StructField("loan_intent", T.StringType()),
    T.StructField("loan_grade", T.StringType()),
    T.StructField("loan_amnt", T.DoubleType()),
    T.StructField("loan_int_rate", T.DoubleType()),
    T.StructField("loan_percent_income", T.DoubleType()),
    T.StructField("cb_person_default_on_file", T.StringType()),
    T.StructField("cb_person_cred_hist_length", T.IntegerType()),
    T.StructField("loan_status", T.IntegerType()),
    T.StructField("officer_notes", T.StringType()),
    T.StructField("note_stress_index", T.DoubleType()),
])


def app_sql(body: str) -> str:
    return S.with_views(S.V_APPLICATIONS, body=body)


def loan_sql(body: str) -> str:
    return S.with_views(S.V_LOANS, body=body)


def bor_sql(body: str) -> str:
    return S.with_views(S.V_BORROWER, body=body)


@register("scan_conform", app_sql("""
SELECT loan_id, person_age, round(person_income, 6) AS person_income, round(person_emp_length, 6) AS person_emp_length,
       person_home_ownership, loan_intent, loan_grade, round(loan_amnt, 6) AS loan_amnt,
       round(loan_int_rate, 6) AS loan_int_rate, round(loan_percent_income, 6) AS loan_percent_income,
       cb_person_default_on_file, cb_person_cred_hist_length, loan_status,
       CAST(NULL AS VARCHAR) AS officer_notes, CAST(0.5 AS DOUBLE) AS note_stress_index
FROM v_applications"""))
def q_scan_conform(spark, sf):
    raw = V.applications(spark, sf)
    conformed = TB.conform(raw, CREDIT_CONTRACT, defaults={"note_stress_index": K.MISSING_NOTE_SCORE},
                           required=["loan_id", "loan_status"])
    return round_doubles(conformed)


@register("coerce_numeric", """
SELECT event_id, event_type,
       coalesce(TRY_CAST(trim(replace(string_split(props, ':')[2], '}', '')) AS DOUBLE), 0.0) AS k_value,
       coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS type_value
FROM events""")
def q_coerce_numeric(spark, sf):
    ev = TB.read_table(spark, sf, "events", ["event_id", "event_type", "props"])
    raw = ev.select("event_id", "event_type",
                    F.trim(F.replace(F.split("props", ":")[1], F.lit("}"), F.lit(""))).alias("k_value"),
                    F.col("event_type").alias("type_value"))
    return TB.coerce_numeric(raw, ["k_value", "type_value"], fill=0.0)


@register("clean_records", app_sql("""
SELECT loan_id, person_age, round(person_emp_length, 6) AS person_emp_length FROM v_applications
WHERE person_age <= 100 AND coalesce(person_emp_length, 0) <= 60"""))
def q_clean_records(spark, sf):
    df = V.applications(spark, sf).select("loan_id", "person_age", "person_emp_length")
    return round_doubles(C.filter_valid(df, C.valid_applicant()))


@register("clean_outliers", bor_sql("""
SELECT company_id, monthly_income, revolving_utilization, num_dependents FROM v_borrower_features
WHERE coalesce(monthly_income, 0) < 9000 AND coalesce(revolving_utilization, 0) < 0.9
  AND coalesce(num_dependents, 0) > 0"""))
def q_clean_outliers(spark, sf):
    df = V.borrowers(spark, sf).select("company_id", "monthly_income", "revolving_utilization", "num_dependents")
    rule = C.outlier_rules({"monthly_income": ("<", 9000.0), "revolving_utilization": ("<", 0.9),
                            "num_dependents": (">", 0)})
    return C.filter_valid(df, rule)


@register("cleaning_audit", app_sql("""
SELECT count(*) AS rows_before,
       count(*) FILTER (WHERE coalesce(person_age <= 100 AND coalesce(person_emp_length, 0) <= 60, false)) AS rows_after,
       round(avg(CAST(loan_status AS DOUBLE)), 6) AS rate_before,
       round(avg(CAST(loan_status AS DOUBLE)) FILTER (WHERE coalesce(person_age <= 100 AND coalesce(person_emp_length, 0) <= 60, false)), 6) AS rate_after
FROM v_applications"""))
def q_cleaning_audit(spark, sf):
    return round_doubles(C.cleaning_audit(V.applications(spark, sf), C.valid_applicant(), "loan_status"))


@register("dedup_rows", app_sql("""
SELECT DISTINCT company_id, loan_grade, loan_intent, person_home_ownership FROM v_applications"""))
def q_dedup_rows(spark, sf):
    return C.dedup(V.applications(spark, sf).select("company_id", "loan_grade", "loan_intent", "person_home_ownership"))


@register("lookup_found", """
SELECT DISTINCT p_partkey AS company_id FROM part WHERE p_partkey IN (SELECT c_custkey FROM customer)""")
def q_lookup_found(spark, sf):
    req = TB.read_table(spark, sf, "part", ["p_partkey"]).select(F.col("p_partkey").alias("company_id")).distinct()
    return C.lookup_ids(V.borrowers(spark, sf), req, "company_id", found=True)


@register("lookup_missing", """
SELECT DISTINCT p_partkey AS company_id FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)""")
def q_lookup_missing(spark, sf):
    req = TB.read_table(spark, sf, "part", ["p_partkey"]).select(F.col("p_partkey").alias("company_id")).distinct()
    return C.lookup_ids(V.borrowers(spark, sf), req, "company_id", found=False)


@register("category_domains", app_sql("""
SELECT DISTINCT 'person_home_ownership' AS "column", person_home_ownership AS value FROM v_applications WHERE person_home_ownership IS NOT NULL
UNION ALL
SELECT DISTINCT 'loan_intent', loan_intent FROM v_applications WHERE loan_intent IS NOT NULL
UNION ALL
SELECT DISTINCT 'loan_grade', loan_grade FROM v_applications WHERE loan_grade IS NOT NULL"""))
def q_category_domains(spark, sf):
    return C.category_domains(V.applications(spark, sf), ["person_home_ownership", "loan_intent", "loan_grade"])


@register("one_hot", bor_sql("""
SELECT company_id, home,
  CASE WHEN home = 'AFRICA' THEN 1.0 ELSE 0.0 END::DOUBLE AS "home_AFRICA",
  CASE WHEN home = 'AMERICA' THEN 1.0 ELSE 0.0 END::DOUBLE AS "home_AMERICA",
  CASE WHEN home = 'ASIA' THEN 1.0 ELSE 0.0 END::DOUBLE AS "home_ASIA",
  CASE WHEN home = 'EUROPE' THEN 1.0 ELSE 0.0 END::DOUBLE AS "home_EUROPE",
  CASE WHEN home = 'MIDDLE EAST' THEN 1.0 ELSE 0.0 END::DOUBLE AS "home_MIDDLE EAST"
FROM v_borrower_features"""))
def q_one_hot(spark, sf):
    return FE.one_hot(V.borrowers(spark, sf).select("company_id", "home"), "home")


@register("grade_encode", app_sql("""
SELECT loan_id, loan_grade, CASE loan_grade WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4
  WHEN 'E' THEN 5 WHEN 'F' THEN 6 WHEN 'G' THEN 7 END AS loan_grade_ord FROM v_applications"""))
def q_grade_encode(spark, sf):
    return V.applications(spark, sf).select("loan_id", "loan_grade", X.grade_encode("loan_grade").alias("loan_grade_ord"))


@register("grade_decode", app_sql("""
SELECT loan_id, CAST(2 * (ascii(loan_grade) - 64) - 1 AS INTEGER) AS grade_code,
  'Grade ' || coalesce(CASE 2 * (ascii(loan_grade) - 64) - 1 WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C'
    WHEN 4 THEN 'D' WHEN 5 THEN 'E' WHEN 6 THEN 'F' WHEN 7 THEN 'G' END, '?') AS grade_label
FROM v_applications"""))
def q_grade_decode(spark, sf):
    code = (2 * X.grade_encode("loan_grade") - 1).cast("int")
    df = V.applications(spark, sf).select("loan_id", code.alias("grade_code"))
    return df.withColumn("grade_label", X.grade_decode("grade_code"))


@register("flag_encode", app_sql("""
SELECT loan_id, cb_person_default_on_file, CAST(coalesce(cb_person_default_on_file = 'Y', false) AS INTEGER) AS default_flag
FROM v_applications"""))
def q_flag_encode(spark, sf):
    return V.applications(spark, sf).select("loan_id", "cb_person_default_on_file",
                                            X.flag("cb_person_default_on_file").alias("default_flag"))


@register("title_case", app_sql(f"""
SELECT DISTINCT person_home_ownership, loan_intent, {S.title_case('person_home_ownership')} AS home_display,
       {S.title_case('loan_intent')} AS intent_display FROM v_applications"""))
def q_title_case(spark, sf):
    df = V.applications(spark, sf).select("person_home_ownership", "loan_intent").distinct()
    return df.select("*", X.title_case("person_home_ownership").alias("home_display"),
                     X.title_case("loan_intent").alias("intent_display"))


@register("clip_bounds", app_sql(f"""
SELECT loan_id, round({S.clip('person_emp_length', 1.0, 40.0)}, 6) AS emp_clipped,
       round({S.clip('person_income', 12000.0, 60000.0)}, 6) AS income_clipped FROM v_applications"""))
def q_clip_bounds(spark, sf):
    df = V.applications(spark, sf)
    return round_doubles(df.select("loan_id", X.clip("person_emp_length", 1.0, 40.0).alias("emp_clipped"),
                                   X.clip("person_income", 12000.0, 60000.0).alias("income_clipped")))


@register("safe_divide", app_sql("""
SELECT loan_id, round(coalesce(loan_amnt / nullif(person_income, 0.0), 0.0), 6) AS amount_to_income,
       round(coalesce(loan_amnt / nullif(person_emp_length, 0.0), 0.5), 6) AS amount_per_year FROM v_applications"""))
def q_safe_divide(spark, sf):
    df = V.applications(spark, sf)
    return round_doubles(df.select("loan_id", X.safe_divide("loan_amnt", "person_income", 0.0).alias("amount_to_income"),
                                   X.safe_divide("loan_amnt", "person_emp_length", 0.5).alias("amount_per_year")))


@register("median_impute", app_sql("""
SELECT loan_id, round(coalesce(person_income, (SELECT median(person_income) FROM v_applications)), 6) AS person_income,
       round(coalesce(person_emp_length, (SELECT median(person_emp_length) FROM v_applications)), 6) AS person_emp_length
FROM v_applications"""))
def q_median_impute(spark, sf):
    df = V.applications(spark, sf).select("loan_id", "person_income", "person_emp_length")
    return round_doubles(C.median_impute(df, ["person_income", "person_emp_length"]))


_Z_COLS = ["loan_amnt", "person_income", "loan_int_rate"]


@register("zscore", app_sql(f"""
SELECT loan_id, {", ".join(f"round(({c} - (SELECT avg({c}) FROM v_applications)) / ((SELECT stddev_samp({c}) FROM v_applications) + {K.ZSCORE_EPS}), 6) AS z_{c}" for c in _Z_COLS)}
FROM v_applications"""))
def q_zscore(spark, sf):
    df = V.applications(spark, sf).select("loan_id", *_Z_COLS)
    return round_doubles(FE.zscore_columns(df, _Z_COLS).drop(*_Z_COLS))


@register("standardise", app_sql(f"""
SELECT loan_id, {", ".join(f"round(({c} - (SELECT avg({c}) FROM v_applications)) / (SELECT stddev_pop({c}) FROM v_applications), 6) AS s_{c}" for c in _Z_COLS)}
FROM v_applications"""))
def q_standardise(spark, sf):
    df = V.applications(spark, sf).select("loan_id", *_Z_COLS)
    return round_doubles(FE.standardise(df, _Z_COLS).drop(*_Z_COLS))


_OVERLAY = ["gst_compliance_score", "emi_delay_count", "cashflow_stress_ratio", "working_capital_usage",
            "revenue_trend_index", "payment_history_score", "supplier_payment_risk"]


@register("behavioural_overlay", bor_sql(f"""
SELECT company_id, {", ".join(f"round({c}, 6) AS {c}" if c != "emi_delay_count" else c for c in _OVERLAY)}
FROM v_borrower_features"""))
def q_behavioural_overlay(spark, sf):
    return round_doubles(V.borrowers(spark, sf).select("company_id", *_OVERLAY))


@register("risk_proxy", bor_sql(f"""
SELECT company_id, round({S.clip('0.35 * revolving_utilization + 0.30 * least(emi_delay_count / 4.0, 1.0) + 0.25 * least(CAST(late_90_days AS DOUBLE), 2.0) / 2.0 + 0.10 * (1 - payment_history_score)', 0.0, 1.0)}, 6) AS risk_proxy
FROM v_borrower_features"""))
def q_risk_proxy(spark, sf):
    return round_doubles(V.borrowers(spark, sf).select("company_id", FE.risk_proxy_msme().alias("risk_proxy")))


@register("risk_proxy_consumer", app_sql(f"""
SELECT loan_id, round({S.clip('0.30 * (ascii(loan_grade) - 64) / 7.0 + 0.30 * least(loan_percent_income / 0.5, 1.0) + 0.25 * (loan_int_rate - 7) / 15.0 + 0.15 * CAST(coalesce(cb_person_default_on_file = ' + "'Y'" + ', false) AS INTEGER)', 0.0, 1.0)}, 6) AS risk_proxy
FROM v_applications"""))
def q_risk_proxy_consumer(spark, sf):
    df = V.applications(spark, sf).select("loan_id", X.grade_encode("loan_grade").alias("loan_grade_ord"),
                                          "loan_percent_income", "loan_int_rate",
                                          X.flag("cb_person_default_on_file").alias("default_flag"))
    return round_doubles(df.select("loan_id", FE.risk_proxy_consumer().alias("risk_proxy")))


@register("scorecard_pd", bor_sql(f"""
SELECT company_id, round(pd, 6) AS pd, round(margin, 6) AS margin FROM v_borrower"""))
def q_scorecard_pd(spark, sf):
    return round_doubles(V.borrowers(spark, sf).select("company_id", "pd", "margin"))


# ----- loan table -----------------------------------------------------------------------

def _loans_labelled(spark, sf):
    return V.loans(spark, sf).withColumn("default_flag", C.status_label("loan_status", FIXTURE_DEFAULT_STATUSES))


@register("status_label", loan_sql("""
SELECT order_id, line_no, loan_status, CAST(coalesce(lower(loan_status) IN ('ro', 'rf'), false) AS INTEGER) AS default_flag
FROM v_loans"""))
def q_status_label(spark, sf):
    return _loans_labelled(spark, sf).select("order_id", "line_no", "loan_status", "default_flag")


@register("status_distribution", loan_sql("""
SELECT loan_status, count(*) AS n FROM v_loans GROUP BY loan_status ORDER BY n DESC"""))
def q_status_distribution(spark, sf):
    return V.loans(spark, sf).groupBy("loan_status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@register("default_rate_by_grade", loan_sql("""
SELECT grade, round(avg(CAST(coalesce(lower(loan_status) IN ('ro', 'rf'), false) AS INTEGER)), 6) AS default_rate,
       count(*) AS n FROM v_loans WHERE grade IS NOT NULL GROUP BY grade"""))
def q_default_rate_by_grade(spark, sf):
    df = _loans_labelled(spark, sf).where(F.col("grade").isNotNull())
    return round_doubles(df.groupBy("grade").agg(F.avg("default_flag").alias("default_rate"),
                                                 F.count(F.lit(1)).alias("n")))


@register("conditional_medians", loan_sql("""
SELECT CAST(coalesce(lower(loan_status) IN ('ro', 'rf'), false) AS INTEGER) AS default_flag,
       round(median(debt_to_income), 6) AS median_dti, round(median(delinq_2y), 6) AS median_delinq,
       round(median(interest_rate), 6) AS median_rate
FROM v_loans GROUP BY 1
UNION ALL
SELECT -1, round(median(debt_to_income), 6), round(median(delinq_2y), 6), round(median(interest_rate), 6) FROM v_loans"""))
def q_conditional_medians(spark, sf):
    cols = {"debt_to_income": "median_dti", "delinq_2y": "median_delinq", "interest_rate": "median_rate"}
    df = _loans_labelled(spark, sf)
    # class -1 = all rows: the class rows and the overall rows go through one exact-quantile job
    both = df.unionByName(df.withColumn("default_flag", F.lit(-1)))
    long = column_quantiles(both, list(cols), (0.5,), ["default_flag"], ["m"])
    wide = long.groupBy("default_flag").pivot("column", list(cols)).agg(F.first("m"))
    return round_doubles(wide.select("default_flag", *[F.col(c).alias(nm) for c, nm in cols.items()]))


_HARMONISED = list(K.MSME_FEATURES)


@register("cross_dataset_features", loan_sql(f"""
SELECT order_id, line_no,
  coalesce({S.clip('total_credit_utilized / nullif(total_credit_limit, 0)', 0.0, 5.0)}, 0.0) AS revolving_utilization,
  round(coalesce(debt_to_income, (SELECT median(debt_to_income) FROM v_loans)), 6) AS debt_ratio,
  coalesce(delinq_2y, 0) AS late_30_59, coalesce(num_accounts_30d_past_due, 0) AS late_60_89,
  coalesce(num_historical_failed_to_pay, 0) AS late_90_days, coalesce(open_credit_lines, 0) AS open_credit_lines,
  coalesce(num_mort_accounts, 0) AS real_estate_loans, 0 AS num_dependents,
  coalesce({S.clip('annual_income / 200000.0', 0.0, 1.0)}, 0.0) AS income_stability,
  {S.clip('1 - coalesce(delinq_2y, 0) * CAST(0.1 AS DOUBLE)', 0.0, 1.0)} AS gst_compliance_score,
  coalesce(num_accounts_30d_past_due, 0) AS emi_delay_count,
  {S.clip('coalesce(debt_to_income, 0.0) / 50.0', 0.0, 5.0)} AS cashflow_stress_ratio,
  coalesce({S.clip('total_credit_utilized / nullif(total_credit_limit, 0)', 0.0, 1.0)}, 0.0) AS working_capital_usage,
  {S.clip('1 - coalesce(interest_rate, 10.0) / 35.0', 0.2, 2.0)} AS revenue_trend_index,
  {S.clip('coalesce(account_never_delinq_percent, 100.0) / 100.0', 0.0, 1.0)} AS payment_history_score,
  CAST(coalesce(num_historical_failed_to_pay, 0) > 0 AS DOUBLE) AS supplier_payment_risk
FROM v_loans"""))
def q_cross_dataset_features(spark, sf):
    out = FE.harmonise_loans(V.loans(spark, sf))
    return out.withColumn("debt_ratio", F.round("debt_ratio", 6))


@register("decimal_rounding", """
SELECT l_orderkey, l_linenumber, (q + CASE WHEN r > 100 OR (r = 100 AND q % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE AS half_discount
FROM (SELECT l_orderkey, l_linenumber, p // 200 AS q, p % 200 AS r
      FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) AS p FROM lineitem))""")
def q_decimal_rounding(spark, sf):
    """Half of each line's discount rounded to two places, halves to the even digit, on exact decimals."""
    lines = TB.read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"])
    half = F.col("l_extendedprice").cast("decimal(20,4)") * F.col("l_discount").cast("decimal(4,2)") * F.lit(0.5).cast("decimal(2,1)")
    return lines.select("l_orderkey", "l_linenumber", X.round_half_even(half, 2).cast("double").alias("half_discount"))
