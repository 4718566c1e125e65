"""Registered model-training queries (spark.ml). Splits and folds have DuckDB oracles; trained
model outputs are rows-only (iterative fits have no SQL equivalent)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import risk_band
from ..operators import attribution as AT
from ..operators import features as FE
from ..operators import metrics as MT
from ..operators import ml as ML
from ..operators import search as SE
from ..operators.clean import status_label
from ..operators.imputer import ExactMedianImputer
from ..operators.ordered import checkpointed
from ..operators.portfolio import round_doubles
from ..sources import tables as TB
from ..sources import views as V
from ..streaming.stream import scratch
from . import sql_views as S
from .record_queries import FIXTURE_DEFAULT_STATUSES
from .registry import register

LABEL = "default"
FEATS = K.MSME_FEATURES


SEED = 42


def split_borrowers(spark, sf, frac=0.2, seed=None):
    return ML.stratified_split(V.borrowers(spark, sf), LABEL, "company_id", frac, seed)


@register("stratified_split", S.with_views(S.BORROWER_FEATURES, body="""
SELECT company_id, "default", CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split
FROM (SELECT company_id, "default", row_number() OVER (PARTITION BY "default" ORDER BY company_id) AS rn,
             count(*) OVER (PARTITION BY "default") AS n FROM v_borrower_features)"""))
def q_stratified_split(spark, sf):
    return split_borrowers(spark, sf).select("company_id", LABEL, "split")


@register("stratified_folds", S.with_views(S.BORROWER_FEATURES, body="""
SELECT company_id, "default", CAST((row_number() OVER (PARTITION BY "default" ORDER BY company_id) - 1) % 3 AS INTEGER) AS fold
FROM v_borrower_features"""))
def q_stratified_folds(spark, sf):
    return ML.stratified_folds(V.borrowers(spark, sf), LABEL, "company_id", 3).select("company_id", LABEL, "fold")


def _train_test(spark, sf):
    d = split_borrowers(spark, sf, seed=SEED).select("company_id", LABEL, "split", *FEATS)
    return d.where(F.col("split") == "train"), d


_SAVED: dict[tuple[str, str], str] = {}


def borrower_trees(spark, sf):
    """The boosted trees of the borrower portfolio: fitted once a session, saved, and read back for every use."""
    slot = (spark.sparkContext.applicationId, f"{sf}:{TB.stamp(spark, sf)}")
    if slot not in _SAVED:
        train, _ = _train_test(spark, sf)
        path = scratch(spark, "gbt_pipeline")
        ML.fit_gbt(train, FEATS, LABEL, max_iter=30, depth=4).write().overwrite().save(path)
        _SAVED[slot] = path
    return PipelineModel.load(_SAVED[slot])


@register("gbt_scores")
def q_gbt_scores(spark, sf):
    _, every = _train_test(spark, sf)
    return ML.score_model(borrower_trees(spark, sf), every).select("company_id", "split", LABEL, "prob").withColumn(
        "band", risk_band("prob"))


@register("logreg_baseline")
def q_logreg_baseline(spark, sf):
    train, every = _train_test(spark, sf)
    model = ML.fit_logreg(train, V.LEGACY_FEATURES, LABEL)
    return ML.score_model(model, every).select("company_id", "split", LABEL, "prob")


@register("rf_scores")
def q_rf_scores(spark, sf):
    train, every = _train_test(spark, sf)
    model = ML.fit_random_forest(train, FEATS, LABEL, trees=50, depth=5)
    return ML.score_model(model, every).select("company_id", "split", LABEL, "prob")


@register("calibrated_scores")
def q_calibrated_scores(spark, sf):
    """Boosted trees fitted on 80 % of train, isotonic map fitted on the other 20 % of train,
    applied to the test split."""
    train, every = _train_test(spark, sf)
    inner = ML.stratified_split(train.drop("split"), LABEL, "company_id", 0.2, seed=SEED + 1).withColumnRenamed("split", "inner")
    fit_part = inner.where(F.col("inner") == "train").drop("inner")
    cal_part = inner.where(F.col("inner") == "test").drop("inner")
    model = ML.fit_gbt(fit_part, FEATS, LABEL, max_iter=30, depth=4)
    iso = ML.calibrate(ML.score_model(model, cal_part), "prob", LABEL)
    test = ML.score_model(model, every.where(F.col("split") == "test"))
    return iso.transform(test).select("company_id", LABEL, "prob", "prob_calibrated")


# The registered search draws fewer and smaller trials than the operator's defaults, which are those of a
# full search (40 trials of 200 to 800 trees on 5 folds).
TRIALS, FOLDS, TREES = 6, 3, ("int", 4, 12, 2)


def search_rows(spark, sf):
    def build():
        train, _ = _train_test(spark, sf)
        folded = checkpointed(ML.stratified_folds(train.drop("split"), LABEL, "company_id", FOLDS, seed=7))
        return SE.successive_halving(folded, FEATS, LABEL, "fold", FOLDS, TRIALS, SE.SPACE | {"trees": TREES})
    return TB.materialise(spark, f"search:{sf}:{TB.stamp(spark, sf)}", build)


@register("cv_results")
def q_cv_results(spark, sf):
    """Successive halving over joint draws of all tree parameters: every rung's trials with their mean AUC over the rung's folds."""
    return search_rows(spark, sf)


_RUNGS = ", ".join(str(x) for x in SE.rungs(TRIALS, FOLDS))


@register("search_rungs", f"""
SELECT CAST(rung AS INT) AS rung, CAST(trials AS BIGINT) AS trials, CAST(folds AS INT) AS folds, true AS in_space, true AS best_go_on
FROM (SELECT row_number() OVER (ORDER BY folds) AS rung, trials, folds FROM (VALUES {_RUNGS}) AS r(trials, folds))
WHERE (SELECT count(*) FROM customer) > 0""")
def q_search_rungs(spark, sf):
    """Rows of the search by rung: how many trials on how many folds, whether every draw lies in its range, and whether those
    that go on are the best of their rung."""
    rows = search_rows(spark, sf)
    inside = None
    for name, (_, low, high, *_rest) in (SE.SPACE | {"trees": TREES}).items():
        ok = F.col(name) >= low if high is None else F.col(name).between(low, high)
        inside = ok if inside is None else inside & ok
    worst_kept, best_left = F.min(F.when(F.col("promoted"), F.col("cv_auc"))), F.max(F.when(~F.col("promoted"), F.col("cv_auc")))
    return rows.groupBy("rung").agg(F.count(F.lit(1)).alias("trials"), F.max("folds").alias("folds"), F.bool_and(inside).alias("in_space"),
                                    (worst_kept >= F.coalesce(best_left, F.lit(0.0))).alias("best_go_on"))


@register("cross_dataset_eval")
def q_cross_dataset_eval(spark, sf):
    """Train on the borrower portfolio, score the harmonised out-of-domain loan lines,
    report AUC and the confusion at the 0.30 early-warning threshold."""
    loans = V.loans(spark, sf).withColumn("y_true", status_label("loan_status", FIXTURE_DEFAULT_STATUSES))
    scored = checkpointed(ML.score_model(borrower_trees(spark, sf), FE.harmonise_loans(loans, keep=["y_true"])).select(
        F.lit("gbt_cross").alias("model"), F.col("order_id").alias("id"), "y_true", "prob"))
    cm = MT.classification_metrics(MT.threshold_counts(scored, [0.30]))
    return round_doubles(MT.roc_auc(scored).join(cm, "model"))


@register("tree_attribution")
def q_tree_attribution(spark, sf):
    """Per-borrower, per-feature TreeSHAP values of the boosted-tree margin (model saved, node
    tables read back, attribution in Arrow batches)."""
    _, every = _train_test(spark, sf)
    model = borrower_trees(spark, sf)
    trees, weights = AT.tree_tables(spark, model.stages[-1], scratch(spark, "gbt_model"))
    return AT.tree_shap_attribution(ML.filled(model, every, FEATS), trees, weights, FEATS)


@register("trained_split_facts", S.with_views(S.BORROWER_FEATURES, body="""
SELECT m.model, s.split, count(*) AS n, sum(f."default") AS defaults, true AS in_range
FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY "default" ORDER BY company_id) <= floor(count(*) OVER (PARTITION BY "default") * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split
      FROM v_borrower_features) f, (VALUES ('trees'), ('forest'), ('logistic')) AS m(model), (VALUES ('train'), ('test')) AS s(split)
WHERE s.split = f.split GROUP BY ALL"""))
def q_trained_split_facts(spark, sf):
    """Facts of the trained models that hold for any fit: rows and defaults of either split (exact quotas a class, whatever the seed) and scores in range."""
    train, every = _train_test(spark, sf)
    models = {"trees": borrower_trees(spark, sf), "forest": ML.fit_random_forest(train, FEATS, LABEL, trees=10, depth=4),
              "logistic": ML.fit_logreg(train, V.LEGACY_FEATURES, LABEL)}
    out = None
    for name, model in models.items():
        facts = ML.score_model(model, every).groupBy(F.lit(name).alias("model"), "split").agg(
            F.count(F.lit(1)).alias("n"), F.sum(LABEL).cast("long").alias("defaults"), F.bool_and(F.col("prob").between(0, 1)).alias("in_range"))
        out = facts if out is None else out.unionByName(facts)
    return out


@register("imputer_medians", S.with_views(S.BORROWER_FEATURES, f"""
tr AS (SELECT * FROM v_borrower_features QUALIFY row_number() OVER (PARTITION BY "default" ORDER BY company_id) > floor(count(*) OVER (PARTITION BY "default") * 0.2 + 0.5)),
tl AS (SELECT feature, value FROM (SELECT {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATS)} FROM tr) UNPIVOT (value FOR feature IN ({", ".join(FEATS)})))""",
    body="SELECT feature, round(median(value), 9) AS median FROM tl GROUP BY feature"))
def q_imputer_medians(spark, sf):
    """Medians of the fitted imputer stage, learnt from the training rows alone (split by id, so that SQL can follow)."""
    train = split_borrowers(spark, sf).where("split = 'train'")
    found = ExactMedianImputer(inputCols=FEATS, outputCols=[f"filled_{f}" for f in FEATS]).fit(train).fitted()
    values = F.create_map(*[x for f, m in found.items() for x in (F.lit(f), F.lit(m))])
    return train.limit(1).select(F.explode(values).alias("feature", "median")).withColumn("median", F.round("median", 9))
