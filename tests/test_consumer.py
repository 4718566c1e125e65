"""Compiled models, the exact median stage, the model bundle, explanations and sentences."""

import math
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from loanlens.functions import constants as K
from loanlens.functions.scalars import title_case
from loanlens.operators import attribution as AT
from loanlens.operators import consumer as CO
from loanlens.operators import ml as ML
from loanlens.operators import search as SE
from loanlens.operators.compiled import isotonic_column, tree_column
from loanlens.operators.imputer import ExactMedianImputer
from loanlens.operators.scorecard import fit_intercept_histogram, score


def applications(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        grade, income = rng.choice("ABCDEFG"), rng.choice([None, float("nan"), rng.uniform(1e4, 2e5), rng.uniform(1e4, 2e5)])
        home, intent = rng.choice(["RENT", "OWN", None]), rng.choice(["MEDICAL", "VENTURE", "HOME_IMPROVEMENT"])
        rate = 5 + 2 * "ABCDEFG".index(grade) + rng.random()
        rows.append((i, i % 90, rng.randint(20, 70), income, home, rng.uniform(0, 9), intent, grade, rng.uniform(1e3, 3e4), rate, rng.random(),
                     rng.choice(["Y", "N", None]), rng.randint(1, 20), int(rng.random() < 0.1 + 0.1 * "ABCDEFG".index(grade)), rng.random()))
    names = ("loan_id long, company_id long, person_age int, person_income double, person_home_ownership string, person_emp_length double, loan_intent string, "
             "loan_grade string, loan_amnt double, loan_int_rate double, loan_percent_income double, cb_person_default_on_file string, "
             "cb_person_cred_hist_length int, loan_status int, note_stress_index double")
    return CO.with_helpers(spark.createDataFrame(rows, names))


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    df = applications(spark)
    model = CO.fit(df, max_iter=6, depth=3)
    iso = ML.calibrate(CO.score(model, df), "prob", "loan_status")
    path = str(tmp_path_factory.mktemp("bundle"))
    CO.save(spark, path, model, iso, {"n": 400})
    return CO.Scorer.load(spark, path)


def test_compiled_model_equals_the_pipeline(spark, bundle):
    new = applications(spark, 150, seed=9)
    odd = new.limit(1).withColumn("loan_id", F.lit(999).cast("long")).withColumn("person_home_ownership", F.lit("BOAT")).withColumn("loan_int_rate", F.lit(None).cast("double"))
    new = new.unionByName(odd)  # a level that training never saw, and a missing number
    ours = {r["loan_id"]: (r["prob"], r["pd"]) for r in bundle.score(new).collect()}
    theirs = {r["loan_id"]: (r["prob"], r["pd"]) for r in bundle.reference_score(new).collect()}
    assert len(ours) == 151 and all(abs(a - b) < 1e-12 for i in ours for a, b in zip(ours[i], theirs[i]))


def test_bundle_document(bundle):
    d = bundle.document
    assert d["numeric"] == CO.NUMERIC and d["text_derived"] == [CO.TEXT] and d["categories"]["person_home_ownership"] == ["OWN", "RENT"]
    assert d["features"][-3:] == ["cat__loan_intent_HOME_IMPROVEMENT", "cat__loan_intent_MEDICAL", "cat__loan_intent_VENTURE"] and d["report"] == {"n": 400}
    assert [n for n, _, _ in bundle.slots] == d["features"]


def test_attribution_adds_up_by_slot_and_by_column(spark, bundle):
    new = applications(spark, 60, seed=5)
    margin = {r["loan_id"]: r["margin"] for r in bundle.score(new).collect()}
    found = bundle.impacts(new, "loan_id").withColumn("columns", CO.by_column("drivers", [*CO.NUMERIC, CO.TEXT, *CO.CATEGORICAL])).collect()
    for r in found:
        assert abs(r["base"] + sum(x["impact"] for x in r["drivers"]) - margin[r["loan_id"]]) < 1e-9
        assert abs(r["base"] + sum(x["impact"] for x in r["columns"]) - margin[r["loan_id"]]) < 1e-9 and len(r["columns"]) == 12
        assert sum(x["value"] for x in r["drivers"] if x["column"] == "loan_intent") == 1.0


def test_drivers_leave_out_other_levels(spark, bundle):
    rows = bundle.impacts(applications(spark, 60, seed=6), "loan_id").select("loan_id", "drivers", CO.top_drivers("drivers").alias("top")).collect()
    for r in rows:
        told = [d for d in r["drivers"] if d["level"] is None or d["value"] > 0.5]
        want = sorted(told, key=lambda d: (-round(abs(d["impact"]), 12), d["feature"]))[:8]
        assert [d["feature"] for d in r["top"]] == [d["feature"] for d in want] and [d["rank"] for d in r["top"]] == list(range(1, 9))
        assert all(d["narrative"] for d in r["top"])


def test_zero_one_slots_split_at_a_half(spark):
    """A tree on a 0/1 slot, however its split is stored, reads as a threshold."""
    tree = (([0, -1, -1]), [0.5, 0, 0], [1, -1, -1], [2, -1, -1], [0.0, -3.0, 7.0], [1, 1, 1])
    df = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    assert [r[0] for r in df.select(tree_column(tree, [F.col("x")])).collect()] == [-3.0, 7.0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65])
def test_isotonic_column(spark, n):
    b = [0.1 * i + 0.05 for i in range(n)]
    p = [i / n for i in range(n)]
    points = sorted(set(b + [x + 0.03 for x in b] + [-1.0, 0.0, 99.0]))

    def want(x):
        if x <= b[0]:
            return p[0]
        if x >= b[-1]:
            return p[-1]
        i = max(k for k in range(n) if b[k] <= x)
        return p[i] + (p[i + 1] - p[i]) * (x - b[i]) / (b[i + 1] - b[i])

    df = spark.createDataFrame([(x,) for x in points] + [(None,)], "x double").select("x", isotonic_column(b, p, F.col("x")).alias("y"))
    for r in df.collect():
        assert r["y"] is None if r["x"] is None else math.isclose(r["y"], want(r["x"]), abs_tol=1e-12)


def test_exact_median_stage(spark, tmp_path):
    train = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (100.0, None), (None, None), (float("nan"), None)], "x double, empty double")
    stages = [ExactMedianImputer(inputCols=["x", "empty"], outputCols=["fx", "fe"]), VectorAssembler(inputCols=["fx", "fe"], outputCol="v")]
    Pipeline(stages=stages).fit(train).write().overwrite().save(str(tmp_path / "m"))
    model = PipelineModel.load(str(tmp_path / "m"))
    assert model.stages[0].fitted() == {"x": 2.5, "empty": 0.0}  # the mean of the middle two, not one of them
    got = model.transform(spark.createDataFrame([(None, 4.0), (float("nan"), None), (9.0, 1.0)], "x double, empty double")).collect()
    assert [(r["fx"], r["fe"]) for r in got] == [(2.5, 4.0), (2.5, 0.0), (9.0, 1.0)]


def test_helpers_only_where_raw_is_there_and_target_is_not(spark):
    raw = spark.createDataFrame([("C", "Y"), ("?", None)], "loan_grade string, cb_person_default_on_file string")
    assert [(r["loan_grade_ord"], r["default_flag"]) for r in CO.with_helpers(raw).collect()] == [(3, 1), (None, 0)]
    kept = CO.with_helpers(raw.withColumn("loan_grade_ord", F.lit(7)))
    assert {r["loan_grade_ord"] for r in kept.collect()} == {7}
    assert CO.with_helpers(raw.drop("loan_grade")).columns == ["cb_person_default_on_file", "default_flag"]


def test_consumer_sentences(spark):
    df = spark.createDataFrame([("person_income", 39999.6), ("loan_int_rate", 15.26), ("loan_grade_ord", 4.0), ("default_flag", 1.0), ("default_flag", 0.0),
                                ("person_emp_length", 1.5), ("loan_percent_income", 0.405), ("other", 1.0), ("loan_grade_ord", 9.0), ("person_income", None)], "f string, v double")
    assert [r[0] for r in df.select(AT.narrative("f", "v", K.NARRATIVES_CONSUMER, 2)).collect()] == [
        "Annual income: $40,000 — low.", "Interest rate: 15.3% — high (subprime).", "Loan grade: D (4/7) — subprime.",
        "Prior default on file — major red flag.", "No prior default on file.", "Employment length: 2 year(s) — short tenure.",
        "Loan is 40% of income — very high burden.", "other: 1.00", "Loan grade: ? (9/7) — subprime.", None]


def test_title_case_breaks_at_every_non_letter(spark):
    text = ["home-improvement", "o'neil AND sons", "3rd élan", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in text], "s string").select(title_case("s")).collect()]
    assert got == [t.title() if t is not None else None for t in text]


def test_rungs_and_draws():
    assert SE.rungs(40, 5) == [(40, 1), (20, 2), (10, 3), (5, 4), (3, 5)] and SE.rungs(1, 2) == [(1, 1), (1, 2)]
    a = SE.draw(SE.SPACE, 200, 9.0)
    assert a == SE.draw(SE.SPACE, 200, 9.0) and a != SE.draw(SE.SPACE, 200, 9.0, seed=1)
    assert {d["trees"] for d in a} <= set(range(200, 801, 50)) and len({d["trees"] for d in a}) > 8
    assert all(1 <= d["positive_weight"] <= 13.5 and 0.01 <= d["step_size"] <= 0.3 and 3 <= d["depth"] <= 9 for d in a)


def test_histogram_intercept_within_its_bound(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.gauss(0, 30) if i % 2 else rng.gauss(5, 0.1)) for i in range(3000)], "id long, x double")
    for target in (0.05, 0.3, 0.8):
        fit = fit_intercept_histogram(df, {"x": (0.0, 1.0)}, {"x": 1.0}, target_rate=target, lo=-200.0, hi=200.0)
        rate = score(df, {"x": (0.0, 1.0)}, {"x": 1.0}, fit.intercept).agg(F.avg("pd")).first()[0]
        assert abs(rate - target) <= fit.error


def test_shapley_shared_by_answers_equals_row_by_row():
    import numpy as np
    rng = np.random.default_rng(4)
    tree = (np.array([0, 1, 2, -1, -1, -1, 0, -1, -1]), np.array([0.5, 0.2, 0.7, 0, 0, 0, 0.8, 0, 0]), np.array([1, 3, 5, -1, -1, -1, 7, -1, -1]),
            np.array([2, 4, 6, -1, -1, -1, 8, -1, -1]), np.arange(9.0), np.array([100.0, 60, 40, 25, 35, 10, 30, 12, 18]))
    x = np.vstack([rng.random((500, 3)), [[np.nan, 0.1, 0.9]]])
    want, got, calls = np.zeros(x.shape), np.zeros(x.shape), []
    AT._tree_shap(x, tree, 0.3, want)
    plain = AT._tree_shap
    try:
        AT._tree_shap = lambda rows, *rest: (calls.append(len(rows)), plain(rows, *rest))
        AT._tree_shap_shared(x, tree, 0.3, got)
    finally:
        AT._tree_shap = plain
    assert np.allclose(want, got, atol=1e-14) and calls[0] <= 16  # four splits, so sixteen ways to answer them at most


def test_drivers_without_a_sentence_make_room(spark):
    """A driver among the first k without a sentence (a value that is missing) leaves its place to the next."""
    rows = [(1, [("a", "x", None, None, 9.0), ("b", "y", None, 1.0, -2.0), ("l", "loan_intent", "MEDICAL", 0.0, 8.0), ("m", "loan_intent", "VENTURE", 1.0, 1.0), ("c", "z", None, 3.0, 0.5)])]
    df = spark.createDataFrame(rows, "id int, drivers array<struct<feature: string, column: string, level: string, value: double, impact: double>>")
    top = df.select(CO.top_drivers("drivers", 2).alias("t")).first()["t"]
    assert [(d["rank"], d["feature"]) for d in top] == [(1, "b"), (2, "m")] and all(d["narrative"] for d in top)


def test_training_rows_are_dealt_out_by_number(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    assert ML.training_frame(df, "y").rdd.getNumPartitions() <= 8
    monkeypatch.setattr(ML, "TRAINING_ROWS", 50)
    parts = ML.training_frame(df, "y")
    sizes = [len(p) for p in parts.rdd.glom().collect()]
    assert len(sizes) == 20 and sum(sizes) == 1000 and max(sizes) <= 100
