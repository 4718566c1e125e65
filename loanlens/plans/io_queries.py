"""Registered source/sink queries: partitioned table round trip with partition pruning,
JSON report round trip, replace-then-append table state, defaults-if-absent, intercept fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import consumer as CO
from ..operators import metrics as MT
from ..operators import upload as UP
from ..operators.features import risk_proxy_consumer
from ..operators.portfolio import round_doubles
from ..operators.scorecard import fit_intercept, fit_intercept_histogram, score
from ..sources import tables as TB
from ..sources import versions as VS
from ..sources import views as V
from ..streaming.stream import scratch
from . import sql_views as S
from .metric_queries import counts_cte
from .portfolio_queries import V_SCORED, scored
from .registry import register


@register("final_snapshot", S.with_views(S.V_PANEL, body="""
SELECT company_id, month, monthly_sales, emi_delay_count, "default" FROM v_panel WHERE month = 12"""))
def q_final_snapshot(spark, sf):
    """Panel written partitioned by month, read back with month = 12 (partition pruning)."""
    path = scratch(spark, "panel_by_month")
    TB.write_table(V.panel(spark, sf), path, partition_by=["month"])
    back = spark.read.parquet(path).where(F.col("month") == 12)
    return back.select("company_id", F.col("month").cast("int").alias("month"), "monthly_sales", "emi_delay_count",
                       "default")


@register("metrics_report", S.with_views(S.V_SCORES, body="""
SELECT model, round(brier, 6) AS brier, n FROM (
  SELECT model, avg(pow(prob - y_true, 2)) AS brier, count(*) AS n FROM v_scores GROUP BY model)"""))
def q_metrics_report(spark, sf):
    """Metric rows written as a JSON report and read back through the tolerant metadata reader."""
    path = scratch(spark, "report")
    s = V.scores(spark, sf)
    rep = MT.brier(s).join(s.groupBy("model").agg(F.count(F.lit(1)).alias("n")), "model")
    TB.write_report(round_doubles(rep), path)
    back = TB.read_metadata(spark, path, multi_line=False)
    missing = TB.read_metadata(spark, path + "-absent")
    assert missing.count() == 0
    return back.select("model", "brier", "n")


@register("portfolio_state", S.with_views(V_SCORED, body="""
SELECT sector, count(*) AS borrowers FROM v_scored GROUP BY sector"""))
def q_portfolio_state(spark, sf):
    """Replace the portfolio table with the current book, append the new batch, read the state."""
    path = scratch(spark, "portfolio")
    s = scored(spark, sf).select("company_id", "sector", "pd")
    TB.write_table(s.where(~F.col("sector").eqNullSafe("HOUSEHOLD")), path, mode="overwrite")
    TB.write_table(s.where(F.col("sector") == "HOUSEHOLD"), path, mode="append")
    return spark.read.parquet(path).groupBy("sector").agg(F.count(F.lit(1)).alias("borrowers"))


@register("conform_defaults", S.with_views(V_SCORED, body=f"""
SELECT company_id, loan_type, CAST(NULL AS VARCHAR) AS officer_notes, CAST({K.MISSING_NOTE_SCORE} AS DOUBLE) AS note_stress_index,
       '[]' AS journey_events FROM v_scored"""))
def q_conform_defaults(spark, sf):
    """Display/meta columns are added only when absent (loan_type exists and is kept)."""
    df = V.borrowers(spark, sf).select("company_id", "loan_type")
    out = TB.add_defaults(df, {"loan_type": K.UPLOAD_DEFAULTS_MSME["loan_type"],
                               "officer_notes": F.lit(None).cast("string"),
                               "note_stress_index": K.MISSING_NOTE_SCORE, "journey_events": "[]"})
    return out


@register("prevalence_intercept")
def q_prevalence_intercept(spark, sf):
    """Intercept that makes the mean scorecard PD equal the target prevalence (grid refinement)."""
    feat = V.borrower_table(spark, sf)
    stats = V.borrower_stats(spark, sf)
    b = fit_intercept(feat, stats, target_rate=K.SCORECARD_TARGET_RATE)
    from ..operators.scorecard import score
    rate = score(feat, stats, intercept=b).agg(F.avg("pd").alias("achieved_rate"))
    return rate.select(F.lit(b).alias("intercept"), F.lit(K.SCORECARD_TARGET_RATE).alias("target_rate"),
                       "achieved_rate")


# ---------------------------------------------------------------- uploads --------------
UPLOAD_CONTRACT = {"loan_id": "bigint", "person_age": "int", "person_income": "double", "person_home_ownership": "string", "person_emp_length": "double", "loan_intent": "string",
                   "loan_grade": "string", "loan_amnt": "double", "loan_int_rate": "double", "loan_percent_income": "double",
                   "cb_person_default_on_file": "string", "cb_person_cred_hist_length": "int"}


@register("upload_quarantine", S.with_views(S.V_APPLICATIONS, """
up AS (SELECT *, CASE WHEN loan_id % 37 = 0 THEN 'not a number: loan_amnt' END AS r1, CASE WHEN loan_id % 53 = 0 OR loan_grade IS NULL THEN 'blank: loan_grade' END AS r2 FROM v_applications),
sc AS (SELECT *, (CASE WHEN loan_grade IS NULL THEN NULL ELSE ascii(loan_grade) - 64 END) AS g, CAST(coalesce(cb_person_default_on_file = 'Y', false) AS INT) AS f FROM up WHERE r1 IS NULL AND r2 IS NULL)""",
    body=f"""
SELECT 'accepted' AS state, '' AS reason, count(*) AS n, count(*) FILTER (WHERE pd >= 0.5) AS high_risk, count(DISTINCT id) AS ids, true AS old_version_kept
FROM (SELECT {S.clip('0.30 * g / 7.0 + 0.30 * least(loan_percent_income / 0.5, 1.0) + 0.25 * (loan_int_rate - 7) / 15.0 + 0.15 * f', 0.0, 1.0)} AS pd, loan_id AS id FROM sc)
UNION ALL SELECT 'quarantine', r, count(*), 0, 0, true FROM (SELECT unnest([x FOR x IN [r1, r2] IF x IS NOT NULL]) AS r FROM up) GROUP BY r"""))
def q_upload_quarantine(spark, sf):
    """Applications uploaded as CSV without borrower ids, some amounts and grades spoiled: accepted and quarantined rows by reason, ids
    given in upload order; a second upload that lacks a column fails and leaves the first version in place."""
    path, root = f"{scratch(spark, 'upload')}.csv", scratch(spark, "book")
    a = V.applications(spark, sf).select(*UPLOAD_CONTRACT)
    text = a.withColumn("loan_amnt", F.when(F.col("loan_id") % 37 == 0, F.lit("n/a")).otherwise(F.col("loan_amnt").cast("string")))
    text = text.withColumn("loan_grade", F.when(F.col("loan_id") % 53 == 0, F.lit(" ")).otherwise(F.col("loan_grade")))
    text.toDF(*[f" {c} " for c in text.columns]).write.option("header", True).csv(path)

    def finish(df):
        return CO.with_helpers(df).withColumn("pd", risk_proxy_consumer())

    first = UP.ingest(spark, path, root, UPLOAD_CONTRACT, ["loan_grade"], finish=finish)
    cut_off = f"{scratch(spark, 'upload')}.csv"
    text.drop("loan_intent").limit(10).write.option("header", True).csv(cut_off)
    try:
        UP.ingest(spark, cut_off, root, UPLOAD_CONTRACT, ["loan_grade"], finish=finish)
        kept = False
    except ValueError:
        kept = VS.current(spark, root) == first
    good, bad = UP.read(spark, root)
    good = good.agg(F.lit("accepted").alias("state"), F.lit("").alias("reason"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("pd") >= K.HIGH_RISK_PD).alias("high_risk"),
                    F.count_distinct("company_id").alias("ids"))
    bad = bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    bad = bad.select(F.lit("quarantine").alias("state"), "reason", "n", F.lit(0).cast("long").alias("high_risk"), F.lit(0).cast("long").alias("ids"))
    return good.unionByName(bad).withColumn("old_version_kept", F.lit(kept))


@register("prevalence_check", S.with_views(S.BORROWER_FEATURES, body=f"""
SELECT count(*) AS borrowers, CAST({K.SCORECARD_TARGET_RATE} AS DOUBLE) AS target_rate, CAST({K.SCORECARD_TARGET_RATE} AS DOUBLE) AS achieved_rate, true AS within_bound FROM v_borrower_features"""))
def q_prevalence_check(spark, sf):
    """The intercept fitted on a histogram of margins: the mean PD that it achieves over all scored borrowers equals the target to four places
    and within the fit's own error bound."""
    feat, stats = V.borrower_table(spark, sf), V.borrower_stats(spark, sf)
    fit = fit_intercept_histogram(feat, stats, target_rate=K.SCORECARD_TARGET_RATE)
    rate = score(feat, stats, intercept=fit.intercept).agg(F.count(F.lit(1)).alias("borrowers"), F.avg("pd").alias("r"))
    return rate.select("borrowers", F.lit(K.SCORECARD_TARGET_RATE).alias("target_rate"), F.round("r", 4).alias("achieved_rate"),
                       (F.abs(F.col("r") - K.SCORECARD_TARGET_RATE) <= fit.error).alias("within_bound"))


@register("nested_report", S.with_views(S.V_SCORES, counts_cte([0.5]), body="""
SELECT c.model, s.n, round(s.rate, 6) AS default_rate, round(s.brier, 6) AS brier, c.tn, c.fp, c.fn, c.tp, 3 AS models, 'threshold 0.5' AS point
FROM cnt c JOIN (SELECT model, count(*) AS n, avg(y_true) AS rate, avg(pow(prob - y_true, 2)) AS brier FROM v_scores GROUP BY model) s ON s.model = c.model"""))
def q_nested_report(spark, sf):
    """Performance report as one nested JSON document (data set, models with quality and confusion matrix), written and read back."""
    s, path = V.scores(spark, sf), scratch(spark, "report")
    quality = s.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("default_rate"))
    rows = MT.threshold_counts(s, [0.5]).join(quality, "model").join(MT.brier(s), "model")
    entry = F.struct("model", "n", F.struct(F.round("default_rate", 6).alias("default_rate"), F.round("brier", 6).alias("brier")).alias("quality"),
                     F.struct("tn", "fp", "fn", "tp").alias("confusion_matrix"))
    document = rows.agg(F.array_sort(F.collect_list(entry)).alias("models"), F.count(F.lit(1)).cast("int").alias("n_models"))  # a row per model
    TB.write_report(document.select(F.struct("n_models", F.lit("threshold 0.5").alias("point")).alias("about"), "models"), path)
    back = TB.read_metadata(spark, path, multi_line=False)
    return back.select("about", F.explode("models").alias("m")).select(
        "m.model", F.col("m.n").alias("n"), "m.quality.default_rate", "m.quality.brier", "m.confusion_matrix.tn", "m.confusion_matrix.fp", "m.confusion_matrix.fn",
        "m.confusion_matrix.tp", F.col("about.n_models").cast("int").alias("models"), "about.point")
