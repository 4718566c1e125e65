"""Consumer model pipeline: impute, one-hot and assemble, boosted trees, isotonic calibration.

The preprocessing stages are part of the fitted pipeline, so medians and category levels come from
the training rows alone and are saved with the model. ``Scorer`` is the same model as column
expressions, for rows that scenarios alter, and with the names that explanations need.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import flag, grade_encode, risk_band, title_case
from . import attribution as AT
from . import ml as ML
from .compiled import isotonic_column, margin_column, probability_column
from .imputer import ExactMedianImputer, present

NUMERIC = ["person_age", "person_income", "person_emp_length", "loan_amnt", "loan_int_rate", "loan_percent_income", "cb_person_cred_hist_length",
           "loan_grade_ord", "default_flag"]
CATEGORICAL = ["person_home_ownership", "loan_intent"]
TEXT = "note_stress_index"


def with_stress(applications: DataFrame, stress: DataFrame) -> DataFrame:
    """Joins the stress index of the applicant's note; without a note it is the neutral 0.5."""
    return (applications.join(stress.select(F.col("doc_id").alias("company_id"), F.col("stress_index").alias(TEXT)), "company_id", "left")
            .withColumn(TEXT, F.coalesce(TEXT, F.lit(K.MISSING_NOTE_SCORE))))


def with_helpers(applications: DataFrame) -> DataFrame:
    """Encoded helper columns, each only where its raw column is there and the helper itself is not."""
    helpers = {"loan_grade_ord": ("loan_grade", grade_encode), "default_flag": ("cb_person_default_on_file", flag)}
    return applications.withColumns({name: make(raw) for name, (raw, make) in helpers.items()
                                     if raw in applications.columns and name not in applications.columns})


def column_transformer(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Medians, then 0/1 slots of the training levels (an unknown or null level has none), in fixed order."""
    filled = [f"filled_{c}" for c in numeric]
    index, hot = [f"index_{c}" for c in categorical], [f"hot_{c}" for c in categorical]
    return [ExactMedianImputer(inputCols=list(numeric), outputCols=filled),
            StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=hot),
            VectorAssembler(inputCols=[*filled, *hot], outputCol="features")]


def fit(train: DataFrame, label: str = "loan_status", numeric: Sequence[str] = (*NUMERIC, TEXT), categorical: Sequence[str] = CATEGORICAL,
        max_iter: int = 20, depth: int = 4, seed: int = 42) -> PipelineModel:
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=max_iter, maxDepth=depth, stepSize=0.1, seed=seed)
    return Pipeline(stages=[*column_transformer(numeric, categorical), gbt]).fit(ML.training_frame(train, label))


def score(model: PipelineModel, df: DataFrame, name: str = "prob") -> DataFrame:
    out = ML.score_model(model, df, name)
    return out.drop(*[c for c in out.columns if c.startswith(("index_", "hot_"))])


def encoded_name(feature: Column, categorical: Sequence[str] = CATEGORICAL) -> Column:
    """struct(column, level) of an encoded feature name: ``column_level`` splits at its column's
    name; a plain numeric name has no level."""
    out = None
    for c in sorted(categorical, key=len, reverse=True):
        hit = F.struct(F.lit(c).alias("column"), F.substring(feature, len(c) + 2, 1 << 20).alias("level"))
        cond = feature.startswith(c + "_")
        out = F.when(cond, hit) if out is None else out.when(cond, hit)
    return out.otherwise(F.struct(feature.alias("column"), F.lit(None).cast("string").alias("level")))


# ---------------------------------------------------------------- model bundle ---------
def schema_document(model: PipelineModel) -> dict:
    """Inputs of a fitted pipeline: numeric and categorical columns, levels, grade map, model features in order, medians."""
    imputer, indexer = model.stages[0], model.stages[1]
    domains = {c: list(levels) for c, levels in zip(indexer.getInputCols(), indexer.labelsArray)}
    numeric = imputer.getInputCols()
    return {"numeric": [c for c in numeric if c != TEXT], "text_derived": [c for c in numeric if c == TEXT], "categorical": list(domains),
            "categories": domains, "grade_map": K.GRADE_MAP, "medians": imputer.fitted(),
            "features": [f"num__{c}" for c in numeric] + [f"cat__{c}_{v}" for c, levels in domains.items() for v in levels]}


def save(spark: SparkSession, path: str, model: PipelineModel, isotonic: IsotonicRegressionModel, report: dict | None = None) -> None:
    """One folder with everything scoring needs: pipeline, isotonic map, schema document, report."""
    model.write().overwrite().save(f"{path}/pipeline")
    isotonic.write().overwrite().save(f"{path}/calibrator")
    document = json.dumps(schema_document(model) | {"report": report or {}}, indent=2)
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


@dataclass
class Scorer:
    """A saved model, read back, and its compiled form."""

    pipeline: PipelineModel
    isotonic: IsotonicRegressionModel
    document: dict
    trees: list
    weights: list[float]

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Scorer":
        pipeline, isotonic = PipelineModel.load(f"{path}/pipeline"), IsotonicRegressionModel.load(f"{path}/calibrator")
        document = json.loads(spark.read.text(f"{path}/schema", wholetext=True).first()[0])
        trees, weights = AT.tree_tables(spark, pipeline.stages[-1], f"{path}/trees")
        return cls(pipeline, isotonic, document, trees, weights)

    @property
    def slots(self) -> list[tuple[str, str, str | None]]:
        """(encoded name, raw column, level) of every model feature, in order."""
        d = self.document
        return ([(f"num__{c}", c, None) for c in d["numeric"] + d["text_derived"]]
                + [(f"cat__{c}_{v}", c, v) for c in d["categorical"] for v in d["categories"][c]])

    def encoded(self, df: DataFrame) -> DataFrame:
        """``df`` with one column ``x<i>`` a model feature: the value with its median, or the 0/1 slot."""
        return df.withColumns({f"x{i}": F.col(c).eqNullSafe(F.lit(v)).cast("double") if v is not None else F.coalesce(present(c), F.lit(self.document["medians"][c]))
                               for i, (_, c, v) in enumerate(self.slots)})

    def margin(self) -> Column:
        return margin_column(self.trees, self.weights, [F.col(f"x{i}") for i in range(len(self.slots))])

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``margin``, ``prob``, the calibrated ``pd`` and ``band``: projections only."""
        out = self.encoded(df).withColumn("margin", self.margin()).withColumn("prob", probability_column(F.col("margin")))
        pd = isotonic_column(self.isotonic.boundaries.toArray().tolist(), self.isotonic.predictions.toArray().tolist(), F.col("prob"))
        return out.withColumn("pd", pd).withColumn("band", risk_band("pd")).drop(*[f"x{i}" for i in range(len(self.slots))])

    def reference_score(self, df: DataFrame) -> DataFrame:
        """Adds ``prob`` and ``pd`` by the fitted spark.ml stages themselves."""
        return self.isotonic.transform(score(self.pipeline, df)).withColumnRenamed("prob_calibrated", "pd")

    # ------------------------------------------------------------ explanations ---------
    def impacts(self, df: DataFrame, key: str) -> DataFrame:
        """key, ``base``, ``drivers``: array of (feature, column, level, value, impact) in model order. The impacts
        are the Shapley values of the margin, so base + their sum is the margin."""
        names = [f"x{i}" for i in range(len(self.slots))]
        found = AT.tree_shap_values(self.encoded(df), self.trees, self.weights, names, key)
        facts = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(c).alias("column"), F.lit(v).cast("string").alias("level")) for n, c, v in self.slots])
        named = found.withColumn("facts", facts)
        return named.select(key, "base", F.zip_with("facts", F.arrays_zip("values", "impacts"), lambda f, x: F.struct(
            f["feature"].alias("feature"), f["column"].alias("column"), f["level"].alias("level"), x["values"].alias("value"), x["impacts"].alias("impact"))).alias("drivers"))


def by_column(drivers: Column | str, columns: Sequence[str]) -> Column:
    """Array of (column, impact): the impacts of a column's slots added up."""
    d = F.col(drivers) if isinstance(drivers, str) else drivers
    return F.array(*[F.struct(F.lit(c).alias("column"), F.aggregate(F.filter(d, lambda x: x["column"] == c), F.lit(0.0), lambda s, x: s + x["impact"]).alias("impact"))
                     for c in columns])


def driver_sentence(driver: Column) -> Column:
    """Sentence of a driver (feature, column, level, value, impact); empty for a level that is not the applicant's."""
    numeric = AT.narrative(driver["column"], driver["value"], K.NARRATIVES_CONSUMER, 2)
    level = None
    for c, template in K.LEVEL_NARRATIVES_CONSUMER.items():
        head, tail = template.split("{level}")
        text = F.concat(F.lit(head), title_case(F.substring_index(driver["level"], "_", -1)), F.lit(tail))
        level = F.when(driver["column"] == c, text) if level is None else level.when(driver["column"] == c, text)
    return F.when(driver["level"].isNull(), numeric).when(driver["value"] > 0.5, level).otherwise(F.lit(""))


def top_drivers(drivers: Column | str, k: int = K.DRIVERS_EXPLAIN) -> Column:
    """The ``k`` drivers of largest absolute impact with a sentence (ties by feature name): no shuffle. Sentences are made for the
    first ``k`` alone; only where one of these has none, for all that may have one."""
    d = F.col(drivers) if isinstance(drivers, str) else drivers
    mine = F.filter(d, lambda x: x["level"].isNull() | F.coalesce(x["value"] > 0.5, F.lit(False)))  # other levels have no sentence
    ranked = F.array_sort(F.transform(mine, lambda x: F.struct((-F.round(F.abs(x["impact"]), 12)).alias("order"), x["feature"].alias("feature"), x["value"].alias("value"),
                                                               x["impact"].alias("impact"), x["column"].alias("column"), x["level"].alias("level"))))
    said = lambda a: F.transform(a, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["impact"].alias("impact"),
                                                       driver_sentence(x).alias("narrative")))
    told = lambda x: F.coalesce(x["narrative"], F.lit("")) != ""
    # bound once each: the ranking, then the first sentences
    bound = F.transform(F.array(ranked), lambda r: F.struct(r.alias("r"), said(F.slice(r, 1, k)).alias("head")))
    rows = F.get(F.transform(bound, lambda b: F.when(F.forall(b["head"], told), b["head"]).otherwise(F.slice(F.filter(said(b["r"]), told), 1, k))), F.lit(0))
    return F.transform(rows, lambda x, i: F.struct((i + 1).alias("rank"), x["feature"].alias("feature"), x["value"].alias("value"),
                                                   x["impact"].alias("impact"), x["narrative"].alias("narrative")))
