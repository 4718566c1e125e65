"""Registered queries of the consumer model: features with text, trained scores, text ablation."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import risk_band
from ..operators import consumer as CO
from ..operators import metrics as MT
from ..operators import ml as ML
from ..operators import portfolio as P
from ..operators import text as TX
from ..operators import trajectory as TR
from ..operators.ordered import checkpointed
from ..operators.portfolio import round_doubles
from ..session import ensure_checkpoint_dir
from ..sources import tables as TB
from ..sources import versions as VS
from ..sources import views as V
from . import sql_views as S
from .registry import register
from .text_queries import _count_sql

LABEL = "loan_status"


def stressed(spark, sf):
    """Stress index of every note by the fixed lexicon."""
    return TX.lexicon_stress(V.notes(spark, sf), "text")


_TABLES = ["orders", "customer", "nation", "region", "documents", "labels"]


def consumer(spark, sf):
    """Applications with the stress of their note, joined and written once a session: models and scenarios read them many times."""
    return TB.materialise(spark, f"consumer:{sf}:{TB.stamp(spark, sf, _TABLES)}",
                          lambda: CO.with_helpers(CO.with_stress(V.applications(spark, sf), stressed(spark, sf))))


_STRESS = f"""
cn AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
cs AS (SELECT doc_id, {_count_sql('t', K.LEXICON_NEGATIVE)} AS neg_hits, {_count_sql('t', K.LEXICON_POSITIVE)} AS pos_hits FROM cn),
cx AS (SELECT *, {S.sigmoid(f'{K.LEXICON_SLOPE} * (neg_hits - pos_hits)')} AS stress_index FROM cs)"""


@register("reference_lexicon", S.with_views(_STRESS, body="SELECT doc_id, neg_hits, pos_hits, round(stress_index, 6) AS stress_index FROM cx"))
def q_reference_lexicon(spark, sf):
    return round_doubles(stressed(spark, sf).select("doc_id", "neg_hits", "pos_hits", "stress_index"))


@register("consumer_features", S.with_views(S.V_APPLICATIONS, _STRESS, body="""
SELECT a.loan_id, a.loan_status, round(coalesce(person_emp_length, (SELECT median(person_emp_length) FROM v_applications)), 6) AS person_emp_length,
       round(coalesce(person_income, (SELECT median(person_income) FROM v_applications)), 6) AS person_income,
       CAST(person_home_ownership IS NOT DISTINCT FROM 'ASIA' AS INTEGER) AS home_asia, round(coalesce(stress_index, 0.5), 6) AS note_stress_index
FROM v_applications a LEFT JOIN cx ON a.company_id = cx.doc_id"""))
def q_consumer_features(spark, sf):
    from ..operators.clean import median_impute
    cols = ["person_emp_length", "person_income"]
    df = median_impute(consumer(spark, sf), cols)
    return round_doubles(df.select("loan_id", LABEL, *cols, F.col("person_home_ownership").eqNullSafe("ASIA").cast("int").alias("home_asia"),
                                   F.col(CO.TEXT)))


@register("encoded_names", S.with_views(S.V_APPLICATIONS, body="""
SELECT DISTINCT 'loan_intent_' || loan_intent AS feature, 'loan_intent' AS "column", loan_intent AS level FROM v_applications WHERE loan_intent IS NOT NULL
UNION ALL SELECT DISTINCT 'loan_grade_' || loan_grade, 'loan_grade', loan_grade FROM v_applications WHERE loan_grade IS NOT NULL
UNION ALL SELECT 'loan_amnt', 'loan_amnt', NULL"""))
def q_encoded_names(spark, sf):
    a = V.applications(spark, sf)
    names = None
    for c in ("loan_intent", "loan_grade"):
        part = a.where(F.col(c).isNotNull()).select(F.concat(F.lit(c + "_"), F.col(c)).alias("feature")).distinct()
        names = part if names is None else names.unionByName(part)
    names = names.unionByName(spark.range(1).select(F.lit("loan_amnt").alias("feature")))
    return names.select("feature", CO.encoded_name(F.col("feature"), [*CO.CATEGORICAL, "loan_grade"]).alias("e")).select("feature", "e.column", "e.level")


def _split(spark, sf):
    """The applications with their split, written once a session."""
    return TB.materialise(spark, f"consumer_split:{sf}:{TB.stamp(spark, sf, _TABLES)}", lambda: ML.stratified_split(consumer(spark, sf), LABEL, "loan_id", 0.2, seed=42))


_BUNDLES: dict[tuple[str, str], str] = {}


def scorer(spark, sf) -> CO.Scorer:
    """The consumer model of this session: trained once on the session's tables, published as a versioned bundle, read
    back for every use. The trees learn from 80 % of the training rows, the isotonic map from the rest."""
    slot = (spark.sparkContext.applicationId, f"{sf}:{TB.stamp(spark, sf, _TABLES)}")
    if slot not in _BUNDLES:
        inner = ML.stratified_split(_split(spark, sf).where("split = 'train'").drop("split"), LABEL, "loan_id", 0.2, seed=43)
        model = CO.fit(inner.where("split = 'train'"))
        iso = ML.calibrate(CO.score(model, inner.where("split = 'test'")), "prob", LABEL)
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/consumer-{uuid.uuid4().hex[:12]}"
        VS.publish(spark, root, lambda path: CO.save(spark, path, model, iso))
        _BUNDLES[slot] = root
    return CO.Scorer.load(spark, VS.current(spark, _BUNDLES[slot]))


def _losses(df):
    out = P.with_lgd(df, "loan_intent", K.LGD_CONSUMER, K.LGD_CONSUMER_DEFAULT)
    return out.withColumn("expected_loss", F.col("pd") * F.col("loan_amnt") * F.col("lgd"))


@register("consumer_scores")
def q_consumer_scores(spark, sf):
    """Every application: calibrated PD of the trained pipeline, band and expected loss, scored from the saved bundle."""
    out = _losses(scorer(spark, sf).score(_split(spark, sf)))
    return out.select("loan_id", "split", LABEL, "prob", "pd", "band", "lgd", "expected_loss")


# Scores agree to this: the pipeline adds up trees and interpolates in another order.
AGREE = 1e-9


@register("compiled_scores", S.with_views(S.V_APPLICATIONS, body="""
SELECT loan_id, true AS same_prob, true AS same_pd, true AS in_range FROM v_applications"""))
def q_compiled_scores(spark, sf):
    """The compiled model against the fitted spark.ml stages, application by application."""
    model, rows = scorer(spark, sf), consumer(spark, sf)
    ours = model.score(rows).select("loan_id", "prob", "pd")
    theirs = model.reference_score(rows).select("loan_id", F.col("prob").alias("prob2"), F.col("pd").alias("pd2"))
    return ours.join(theirs, "loan_id").select("loan_id", (F.abs(F.col("prob") - F.col("prob2")) < AGREE).alias("same_prob"),
                                               (F.abs(F.col("pd") - F.col("pd2")) < AGREE).alias("same_pd"), F.col("pd").between(0, 1).alias("in_range"))


def trajectory(spark, sf):
    """Twelve scenario months of every application, rescored by the compiled model in one projection."""
    return scorer(spark, sf).score(TR.consumer_scenarios(consumer(spark, sf)))


@register("consumer_trajectory")
def q_consumer_trajectory(spark, sf):
    """Forward PD of every application by the trained model, month by month."""
    return trajectory(spark, sf).select("loan_id", "month_idx", "month", "pd", "band")


@register("consumer_trajectory_check", S.with_views(S.V_APPLICATIONS, body="""
SELECT loan_id, 12 AS months, true AS in_order, true AS same_pd, true AS same_band, true AS migrated_as_banded FROM v_applications"""))
def q_consumer_trajectory_check(spark, sf):
    """Facts of ``consumer_trajectory`` that hold for any trained model: twelve months in order, every PD the one
    the spark.ml stages give the altered row, bands by the cuts, migration from the first month's band to the current one."""
    model = scorer(spark, sf)
    ours = model.score(TR.consumer_scenarios(consumer(spark, sf))).drop("margin", "prob").withColumnsRenamed({"pd": "ours", "band": "ours_band"})
    both = model.reference_score(ours).select("loan_id", "month_idx", "month", F.col("ours").alias("pd"), F.col("ours_band").alias("band"), F.col("pd").alias("pd2"))
    each = TR.folded(both, "loan_id", "part").groupBy("loan_id").agg(F.flatten(F.collect_list("part")).alias("m"))  # twelve months an application
    # rows that share a loan_id are compared with each other as well, month by month
    crossed = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y["month_idx"] == x["month_idx"]), lambda y: x.withField("pd2", y["pd2"]))))
    pairs = each.withColumn("m", F.when(F.size("m") > TR.MONTHS, crossed).otherwise(F.col("m")))
    months = pairs.select("loan_id", F.size("m").alias("months"), F.array_sort(F.transform("m", lambda x: F.struct(x["month_idx"], x["month"]))).alias("in_turn"),
                          F.array_max(F.transform("m", lambda x: F.abs(x["pd"] - x["pd2"]))).alias("off"),
                          F.forall("m", lambda x: F.coalesce(x["band"] == risk_band(x["pd2"]), F.lit(True))).alias("same_band"),
                          F.array_min(F.transform("m", lambda x: F.struct(x["month_idx"].alias("month_idx"), x["pd"].alias("pd"))))["pd"].alias("first"))
    now = model.reference_score(consumer(spark, sf)).select("loan_id", F.col("pd").alias("now"))
    ours = q_consumer_migration(spark, sf)
    order = F.transform("in_turn", lambda x: x["month"]) == F.array(*[F.lit(x) for x in K.SCENARIO_MONTHS])
    return (months.join(now, "loan_id").join(ours, "loan_id")
            .select("loan_id", "months", order.alias("in_order"), (F.col("off") < AGREE).alias("same_pd"), "same_band",
                    ((F.col("start_band") == risk_band("first")) & (F.col("end_band") == risk_band("now"))).alias("migrated_as_banded")))


@register("consumer_migration")
def q_consumer_migration(spark, sf):
    """Band of the first scenario month against the band of the current PD, by the trained model."""
    current = scorer(spark, sf).score(consumer(spark, sf))
    return TR.migration(trajectory(spark, sf), current, "loan_id").select("loan_id", "start_band", "end_band", "migrated")


# ---------------------------------------------------------------- explanations ---------
@register("consumer_attribution")
def q_consumer_attribution(spark, sf):
    """Shapley values of the margin by raw input column: the slots of a category are added up."""
    columns = [*CO.NUMERIC, CO.TEXT, *CO.CATEGORICAL]
    found = scorer(spark, sf).impacts(consumer(spark, sf), "loan_id")
    return found.select("loan_id", "base", F.inline(CO.by_column("drivers", columns))).withColumnRenamed("column", "feature")


@register("consumer_attribution_check", S.with_views(S.V_APPLICATIONS, body="""
SELECT loan_id, 12 AS features, true AS additive, true AS one_level_each FROM v_applications"""))
def q_consumer_attribution_check(spark, sf):
    """Additivity of the attribution: base and impacts, by slot and by raw column, add up to the spark.ml margin, and
    no category has more than one level set."""
    model, rows = scorer(spark, sf), consumer(spark, sf)
    columns = [*CO.NUMERIC, CO.TEXT, *CO.CATEGORICAL]
    found = model.impacts(rows, "loan_id").withColumn("columns", CO.by_column("drivers", columns))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x["impact"])
    chosen = lambda c: F.size(F.filter("drivers", lambda x: (x["column"] == c) & (x["value"] > 0.5)))
    levels = [chosen(c) for c in CO.CATEGORICAL]
    # an application's arrays become four values before its rows are dealt out by the key
    facts = found.select("loan_id", F.size("columns").alias("features"), (F.col("base") + total("drivers")).alias("by_slot"),
                         (F.col("base") + total("columns")).alias("by_column"), F.greatest(*levels).between(0, 1).alias("one_level_each"))
    margin = model.pipeline.transform(rows).select("loan_id", vector_to_array("rawPrediction")[1].alias("margin"))
    return facts.join(margin, "loan_id").select(
        "loan_id", "features", ((F.abs(F.col("by_slot") - F.col("margin")) < AGREE) & (F.abs(F.col("by_column") - F.col("margin")) < AGREE)).alias("additive"),
        "one_level_each")


@register("consumer_drivers")
def q_consumer_drivers(spark, sf):
    """The eight strongest drivers of every application with their sentences; levels that are not the applicant's are left out."""
    found = scorer(spark, sf).impacts(consumer(spark, sf), "loan_id")
    return found.select("loan_id", F.inline(CO.top_drivers("drivers")))


@register("consumer_ablation")
def q_consumer_ablation(spark, sf):
    """Held-out metrics of the trained pipeline with and without the text feature."""
    every = _split(spark, sf)
    train, test = every.where("split = 'train'"), every.where("split = 'test'")
    scored = None
    for name, numeric in (("structured", CO.NUMERIC), ("with_text", [*CO.NUMERIC, CO.TEXT])):
        part = CO.score(CO.fit(train, numeric=numeric, max_iter=10), test).select(
            F.lit(name).alias("model"), F.col("loan_id").alias("id"), F.col(LABEL).alias("y_true"), "prob")
        scored = part if scored is None else scored.unionByName(part)
    return MT.model_comparison(checkpointed(scored))


@register("schema_document", S.with_views(S.V_APPLICATIONS, body=f"""
SELECT 'numeric' AS kind, c AS name, NULL AS level FROM (VALUES {", ".join(f"('{c}')" for c in CO.NUMERIC)}) AS v(c) WHERE (SELECT count(*) FROM v_applications) > 0
UNION ALL SELECT 'text_derived', '{CO.TEXT}', NULL
UNION ALL SELECT DISTINCT 'category', 'person_home_ownership', person_home_ownership FROM v_applications WHERE person_home_ownership IS NOT NULL
UNION ALL SELECT DISTINCT 'category', 'loan_intent', loan_intent FROM v_applications WHERE loan_intent IS NOT NULL"""))
def q_schema_document(spark, sf):
    """The schema document of the saved bundle: numeric inputs, the text feature, and the levels of each category."""
    d = scorer(spark, sf).document
    rows = [("numeric", c, None) for c in d["numeric"]] + [("text_derived", c, None) for c in d["text_derived"]]
    rows += [("category", c, v) for c, levels in d["categories"].items() for v in levels]
    return spark.createDataFrame(rows, "kind string, name string, level string")
