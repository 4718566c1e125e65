"""Registered model-quality queries over the scores view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import metrics as MT
from ..operators.portfolio import round_doubles
from ..sources import views as V
from . import sql_views as S
from .registry import register


def _grid_sql(ts) -> str:
    return ", ".join(f"({i + 1}, CAST('{t!r}' AS DOUBLE))" for i, t in enumerate(ts))


GRID = MT.linspace()
OPS = list(K.OPERATING_POINTS)


def ssql(body: str, *extra: str) -> str:
    return S.with_views(S.V_SCORES, *extra, body=body)


def counts_cte(ts, name="cnt") -> str:
    return f"""
grid_{name} AS (SELECT * FROM (VALUES {_grid_sql(ts)}) AS g(b, threshold)),
{name} AS (
  SELECT s.model, g.threshold,
         count(*) FILTER (WHERE s.prob < g.threshold AND s.y_true = 0) AS tn,
         count(*) FILTER (WHERE s.prob >= g.threshold AND s.y_true = 0) AS fp,
         count(*) FILTER (WHERE s.prob < g.threshold AND s.y_true = 1) AS fn,
         count(*) FILTER (WHERE s.prob >= g.threshold AND s.y_true = 1) AS tp
  FROM v_scores s CROSS JOIN grid_{name} g GROUP BY s.model, g.threshold)"""


def d0(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def metrics_cols(r: int = 6) -> str:
    return (f"round({d0('tp + tn', 'tn + fp + fn + tp')}, {r}) AS accuracy, round({d0('tp', 'tp + fp')}, {r}) AS precision, "
            f"round({d0('tp', 'tp + fn')}, {r}) AS recall, round({d0('2 * tp', '2 * tp + fp + fn')}, {r}) AS f1, "
            f"round({d0('tn', 'tn + fp')}, {r}) AS specificity, round({d0('fn', 'fn + tp')}, {r}) AS miss_rate")


@register("confusion_matrix", ssql("SELECT model, threshold, tn, fp, fn, tp FROM cnt", counts_cte([0.5])))
def q_confusion_matrix(spark, sf):
    return MT.threshold_counts(V.scores(spark, sf), [0.5])


@register("classification_metrics", ssql(f"SELECT model, threshold, tn, fp, fn, tp, {metrics_cols()} FROM cnt",
                                         counts_cte([0.5])))
def q_classification_metrics(spark, sf):
    return round_doubles(MT.classification_metrics(MT.threshold_counts(V.scores(spark, sf), [0.5])))


@register("operating_points", ssql(f"SELECT model, threshold, tn, fp, fn, tp, {metrics_cols()} FROM cnt",
                                   counts_cte(OPS)))
def q_operating_points(spark, sf):
    return round_doubles(MT.classification_metrics(MT.threshold_counts(V.scores(spark, sf), OPS)))


@register("threshold_sweep", ssql(f"SELECT model, round(threshold, 6) AS threshold, tp, fp, {metrics_cols()} FROM cnt",
                                  counts_cte(GRID)))
def q_threshold_sweep(spark, sf):
    sw = MT.threshold_sweep(V.scores(spark, sf))
    return round_doubles(sw.drop("tn", "fn"))


SWEEP = counts_cte(GRID) + f""",
sw AS (SELECT model, threshold, {d0('tp', 'tp + fp')} AS precision, {d0('tp', 'tp + fn')} AS recall,
              {d0('2 * tp', '2 * tp + fp + fn')} AS f1 FROM cnt)"""


@register("best_f1_threshold", ssql("""
SELECT model, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold ASC) AS rn FROM sw) WHERE rn = 1""", SWEEP))
def q_best_f1_threshold(spark, sf):
    return round_doubles(MT.best_f1_threshold(MT.threshold_sweep(V.scores(spark, sf))))


@register("recall_floor_threshold", ssql("""
SELECT m.model, coalesce(x.threshold, 0.3) AS threshold, x.threshold IS NOT NULL AS recall_met
FROM (SELECT DISTINCT model FROM sw) m LEFT JOIN (
  SELECT model, threshold FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY precision DESC, threshold ASC) AS rn
    FROM sw WHERE recall >= 0.85) WHERE rn = 1) x ON m.model = x.model""", SWEEP))
def q_recall_floor_threshold(spark, sf):
    return MT.recall_floor_threshold(MT.threshold_sweep(V.scores(spark, sf)))


RANKED = """
sg AS (SELECT model, prob, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg
       FROM v_scores WHERE prob IS NOT NULL GROUP BY model, prob),
rk AS (
  SELECT model, prob, pos, neg,
         sum(pos) OVER (PARTITION BY model) AS "P", sum(neg) OVER (PARTITION BY model) AS "N",
         sum(pos) OVER (PARTITION BY model ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_at,
         sum(neg) OVER (PARTITION BY model ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_at,
         coalesce(sum(neg) OVER (PARTITION BY model ORDER BY prob ASC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM sg)"""


@register("roc_auc", ssql("""
SELECT model, round(CAST(sum(pos * (neg_below + neg / 2.0)) AS DOUBLE) / CAST(max("P") * max("N") AS DOUBLE), 6) AS roc_auc
FROM rk GROUP BY model""", RANKED))
def q_roc_auc(spark, sf):
    return round_doubles(MT.roc_auc(V.scores(spark, sf)))


@register("average_precision", ssql("""
SELECT model, round(sum(CAST(pos AS DOUBLE) / "P" * (CAST(tp_at AS DOUBLE) / (tp_at + fp_at))), 6) AS average_precision
FROM rk GROUP BY model""", RANKED))
def q_average_precision(spark, sf):
    return round_doubles(MT.average_precision(V.scores(spark, sf)))


@register("roc_curve", ssql("""
SELECT model, prob AS threshold, round(CAST(fp_at AS DOUBLE) / "N", 6) AS fpr, round(CAST(tp_at AS DOUBLE) / "P", 6) AS tpr
FROM rk""", RANKED))
def q_roc_curve(spark, sf):
    return round_doubles(MT.roc_curve(V.scores(spark, sf)), 6, {"threshold": V.SCORE_PLACES})


@register("pr_curve", ssql("""
SELECT model, prob AS threshold, round(CAST(tp_at AS DOUBLE) / (tp_at + fp_at), 6) AS precision,
       round(CAST(tp_at AS DOUBLE) / "P", 6) AS recall FROM rk""", RANKED))
def q_pr_curve(spark, sf):
    return round_doubles(MT.pr_curve(V.scores(spark, sf)), 6, {"threshold": V.SCORE_PLACES})


_EPS = "2.220446049250313e-16"


@register("log_loss", ssql(f"""
SELECT model, round(avg(-(y_true * ln(least(greatest(prob, {_EPS}), 1 - {_EPS}))
                         + (1 - y_true) * ln(1 - least(greatest(prob, {_EPS}), 1 - {_EPS})))), 6) AS log_loss
FROM v_scores GROUP BY model"""))
def q_log_loss(spark, sf):
    return round_doubles(MT.log_loss(V.scores(spark, sf)))


@register("brier", ssql("SELECT model, round(avg(pow(prob - y_true, 2)), 6) AS brier FROM v_scores GROUP BY model"))
def q_brier(spark, sf):
    return round_doubles(MT.brier(V.scores(spark, sf)))


@register("score_histogram", ssql("""
SELECT s.model, s.y_true, CAST(least(floor((s.prob - r.lo) * (50.0 / (r.hi - r.lo))), 49) AS INTEGER) AS bin,
       count(*) AS count, round(min(r.lo) + CAST(least(floor((s.prob - r.lo) * (50.0 / (r.hi - r.lo))), 49) AS INTEGER) * (min(r.hi) - min(r.lo)) / 50, 9) AS bin_start,
       round(count(*) / (min(r.n) * ((min(r.hi) - min(r.lo)) / 50)), 6) AS density
FROM (SELECT * FROM v_scores WHERE prob IS NOT NULL) s JOIN (
  SELECT model, y_true, count(*) AS n,
         CASE WHEN min(prob) = max(prob) THEN min(prob) - 0.5 ELSE min(prob) END AS lo,
         CASE WHEN min(prob) = max(prob) THEN max(prob) + 0.5 ELSE max(prob) END AS hi
  FROM v_scores WHERE prob IS NOT NULL GROUP BY model, y_true) r ON s.model = r.model AND s.y_true = r.y_true
GROUP BY s.model, s.y_true, 3"""))
def q_score_histogram(spark, sf):
    return round_doubles(MT.score_histogram(V.scores(spark, sf)), 6, {"bin_start": 9})


@register("model_comparison", ssql(f"""
SELECT a.model, a.roc_auc, p.average_precision, l.log_loss, b.brier, c.tn, c.fp, c.fn, c.tp,
       {metrics_cols()}, a.model = (SELECT arg_max(model, (roc_auc, model)) FROM auc) AS is_best
FROM auc a JOIN ap p ON a.model = p.model JOIN ll l ON a.model = l.model JOIN br b ON a.model = b.model
JOIN cnt c ON a.model = c.model""", RANKED, counts_cte([0.5]), f"""
auc AS (SELECT model, round(CAST(sum(pos * (neg_below + neg / 2.0)) AS DOUBLE) / CAST(max("P") * max("N") AS DOUBLE), 6) AS roc_auc FROM rk GROUP BY model),
ap AS (SELECT model, round(sum(CAST(pos AS DOUBLE) / "P" * (CAST(tp_at AS DOUBLE) / (tp_at + fp_at))), 6) AS average_precision FROM rk GROUP BY model),
ll AS (SELECT model, round(avg(-(y_true * ln(least(greatest(prob, {_EPS}), 1 - {_EPS})) + (1 - y_true) * ln(1 - least(greatest(prob, {_EPS}), 1 - {_EPS})))), 6) AS log_loss FROM v_scores GROUP BY model),
br AS (SELECT model, round(avg(pow(prob - y_true, 2)), 6) AS brier FROM v_scores GROUP BY model)"""))
def q_model_comparison(spark, sf):
    t = round_doubles(MT.model_comparison(V.scores(spark, sf)))
    return t.select("model", "roc_auc", "average_precision", "log_loss", "brier", "tn", "fp", "fn", "tp",
                    "accuracy", "precision", "recall", "f1", "specificity", "miss_rate", "is_best")


@register("ablation_lift", ssql("""
SELECT round(max(roc_auc) FILTER (WHERE model = 'legacy3'), 6) AS auc_base, round(max(roc_auc) FILTER (WHERE model = 'scorecard'), 6) AS auc_full,
       round(max(roc_auc) FILTER (WHERE model = 'scorecard') - max(roc_auc) FILTER (WHERE model = 'legacy3'), 4) AS lift
FROM (SELECT model, CAST(sum(pos * (neg_below + neg / 2.0)) AS DOUBLE) / CAST(max("P") * max("N") AS DOUBLE) AS roc_auc
      FROM rk GROUP BY model)""", RANKED))
def q_ablation_lift(spark, sf):
    out = MT.ablation_lift(V.scores(spark, sf), "legacy3", "scorecard")
    return out.select(F.round("auc_base", 6).alias("auc_base"), F.round("auc_full", 6).alias("auc_full"), "lift")
