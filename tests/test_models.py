"""Scorecard, attribution additivity, intercept search, splits and calibration."""

import math

import numpy as np
from pyspark.sql import functions as F

from loanlens.functions import constants as K
from loanlens.operators import attribution as AT
from loanlens.operators import ml as ML
from loanlens.operators.scorecard import fit_intercept, fit_zscore, score


def feature_frame(spark, n=200, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((i, int(rng.integers(0, 2)), *[float(v) for v in rng.normal(size=len(K.MSME_FEATURES))]))
    cols = ", ".join(f"{f} double" for f in K.MSME_FEATURES)
    return spark.createDataFrame(rows, f"company_id long, default int, {cols}")


def test_attribution_is_additive(spark):
    df = feature_frame(spark)
    stats = fit_zscore(df, K.MSME_FEATURES)
    scored = score(df, stats, intercept=-2.0)
    attr = AT.linear_attribution(scored, stats).groupBy("company_id").agg(F.sum("impact").alias("s"))
    j = scored.join(attr, "company_id").select((F.col("s") - 2.0 - F.col("margin")).alias("d")).collect()
    assert max(abs(r["d"]) for r in j) < 1e-9


def test_intercept_hits_target_rate(spark):
    df = feature_frame(spark, n=400)
    stats = fit_zscore(df, K.MSME_FEATURES)
    b = fit_intercept(df, stats, target_rate=0.15)
    rate = score(df, stats, intercept=b).agg(F.avg("pd")).first()[0]
    assert abs(rate - 0.15) < 1e-3


def test_stratified_split_exact_quota(spark):
    df = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(1000)], "company_id long, default int")
    out = ML.stratified_split(df, "default", "company_id", 0.2, seed=11)
    counts = {(r["default"], r["split"]): r["count"] for r in out.groupBy("default", "split").count().collect()}
    assert counts[(1, "test")] == 50 and counts[(0, "test")] == 150
    assert counts[(1, "train")] == 200 and counts[(0, "train")] == 600


def test_folds_balanced(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(90)], "company_id long, default int")
    out = ML.stratified_folds(df, "default", "company_id", 3)
    sizes = [r["count"] for r in out.groupBy("fold", "default").count().collect()]
    assert sorted(sizes) == [15] * 6


def test_isotonic_is_monotone(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(size=300)
    y = (rng.uniform(size=300) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "prob double, default int")
    model = ML.calibrate(df, "prob", "default")
    out = sorted((r["prob"], r["prob_calibrated"]) for r in model.transform(df).collect())
    assert all(b1 <= b2 + 1e-12 for (_, b1), (_, b2) in zip(out, out[1:]))


def test_narratives(spark):
    df = spark.createDataFrame([("revolving_utilization", 0.755), ("emi_delay_count", 0.0), ("debt_ratio", 1.234),
                                ("supplier_payment_risk", 1.0), ("unknown_feature", 0.5)],
                               "feature string, value double")
    got = [r[0] for r in df.select(AT.narrative("feature", "value")).collect()]
    assert got[0] == "Working capital line utilized at 76% — dangerously high."
    assert got[1] == "EMI delays recorded: 0 — no delays."
    assert got[2] == "Debt-to-income ratio is 1.23 — critical."
    assert got[3] == "Supplier payment risk flag: Active — delays to creditors detected."
    assert got[4] == "unknown_feature: 0.500"


def test_tree_attribution_additive(spark, tmp_path):
    from pyspark.ml.functions import vector_to_array
    df = feature_frame(spark, n=300, seed=9)
    model = ML.fit_gbt(df, K.MSME_FEATURES, "default", max_iter=8, depth=3)
    trees, weights = AT.tree_tables(spark, model.stages[-1], str(tmp_path / "gbt"))
    attr = AT.tree_path_attribution(df, trees, weights, K.MSME_FEATURES)
    total = attr.groupBy("company_id").agg((F.sum("impact") + F.first("base")).alias("f"))
    raw = model.transform(df).select("company_id", vector_to_array("rawPrediction")[1].alias("margin"))
    diff = total.join(raw, "company_id").select(F.max(F.abs(F.col("f") - F.col("margin")))).first()[0]
    assert diff < 1e-9


def _brute_shapley(model_trees, weights, x, d):
    """Exact Shapley values by enumeration over feature subsets with the interventional-free
    conditional expectation TreeSHAP uses (cover-weighted descent for missing features)."""
    import itertools
    import math

    def expect(tree, xrow, S, j=0):
        feat, thr, left, right, value, cover = tree
        if feat[j] < 0:
            return value[j]
        f = feat[j]
        if f in S:
            return expect(tree, xrow, S, left[j] if xrow[f] <= thr[j] else right[j])
        return (cover[left[j]] * expect(tree, xrow, S, left[j]) + cover[right[j]] * expect(tree, xrow, S, right[j])) / cover[j]

    def v(S):
        return sum(w * expect(t, x, S) for t, w in zip(model_trees, weights))

    phi = [0.0] * d
    for i in range(d):
        others = [k for k in range(d) if k != i]
        for r in range(len(others) + 1):
            for S in itertools.combinations(others, r):
                c = math.factorial(len(S)) * math.factorial(d - len(S) - 1) / math.factorial(d)
                phi[i] += c * (v(set(S) | {i}) - v(set(S)))
    return phi


def test_tree_shap_matches_enumeration_and_is_additive(spark, tmp_path):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    feats = K.MSME_FEATURES[:5]
    df = feature_frame(spark, n=200, seed=4)
    model = ML.fit_gbt(df, feats, "default", max_iter=4, depth=3)
    trees, weights = AT.tree_tables(spark, model.stages[-1], str(tmp_path / "gbt"))
    shap = AT.tree_shap_attribution(df, trees, weights, feats)
    total = shap.groupBy("company_id").agg((F.sum("impact") + F.first("base")).alias("f"))
    raw = model.transform(df).select("company_id", vector_to_array("rawPrediction")[1].alias("margin"))
    assert total.join(raw, "company_id").select(F.max(F.abs(F.col("f") - F.col("margin")))).first()[0] < 1e-9
    rows = df.where("company_id < 3").select("company_id", *feats).collect()
    got = {(r["company_id"], r["feature"]): r["impact"] for r in shap.where("company_id < 3").collect()}
    for r in rows:
        x = np.array([r[f] for f in feats])
        want = _brute_shapley(trees, weights, x, len(feats))
        for i, f in enumerate(feats):
            assert abs(got[(r["company_id"], f)] - want[i]) < 1e-9
